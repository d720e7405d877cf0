"""Scalar functions: values on ingest, and the same rules as column expressions."""
