"""Flattening a stream: the projection is stateless, so a streaming DataFrame goes through as it is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..plans.record import plan_of


def flatten_stream(df: DataFrame, of: Any) -> DataFrame:
    """``df`` in the flat columns of the record type ``of``, still a stream."""
    if not df.isStreaming:
        raise ValueError("not a stream; use the plan's flatten")
    return plan_of(of).flatten(df)
