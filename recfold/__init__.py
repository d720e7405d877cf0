"""Record types to flat, typed DataFrames, on Spark.

Declare a dataclass or NamedTuple with ``record``; ``to_df`` turns records into a flat DataFrame, and a
plan's ``flatten`` does the same to a nested DataFrame, batch or streaming, in one projection.
"""

from .attrs import as_binary, as_str, as_string, decimal, skip, time_unit
from .errors import EncodeError, RecordError
from .plans.record import RecordPlan, plan_of, record, to_df
from .runtime import DEFAULT, Runtime

__all__ = ["DEFAULT", "EncodeError", "RecordError", "RecordPlan", "Runtime", "as_binary", "as_str", "as_string", "decimal", "plan_of", "record", "skip", "time_unit", "to_df"]
