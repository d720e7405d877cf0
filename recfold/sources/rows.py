"""In-memory records as a nested DataFrame: the only place where Python looks at rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EncodeError

#: Records that are encoded, checked and turned into Arrow at a time.
BATCH_ROWS = 10_000


def ingest(spark: SparkSession, rows: list[Any], encode: Callable[[list[Any]], list[tuple]], schema: T.StructType) -> DataFrame:
    """Encoded rows under the nested schema, handed over as Arrow batches. Values are checked and rescaled before Spark sees them."""
    if not schema.fields:  # rows without columns
        return spark.createDataFrame([() for _ in encode(rows)], schema)
    arrow = to_arrow_schema(schema)
    kind, batches = pa.struct(list(arrow)), []
    for first in range(0, len(rows), BATCH_ROWS):
        made = encode(rows[first : first + BATCH_ROWS])
        try:
            batches.append(pa.RecordBatch.from_struct_array(pa.array(made, kind)))
        except (pa.ArrowException, TypeError, ValueError) as e:
            raise EncodeError(f"values don't fit their columns: {e}") from e
    return spark.createDataFrame(pa.Table.from_batches(batches), schema)
