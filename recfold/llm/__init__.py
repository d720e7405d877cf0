"""Training-data operators: packing, filtering, deduplication, tokenising and formatting.

Nothing else in the library imports this subpackage.
"""
