"""Record plans: schema, ingest and flattening of one record type."""

from __future__ import annotations

import typing
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.flatten import flat_columns, flatten
from ..runtime import Runtime, chosen
from ..sources.rows import ingest
from ..types import Logical, carrier
from .analyze import Analyzer, LeafType, ListType, OptionType, StructType, encoder

_PLANS: dict[Any, RecordPlan] = {}


def _spark_type(t: Any) -> T.DataType:
    if isinstance(t, LeafType):
        return carrier(t.logical)
    if isinstance(t, OptionType):
        return _spark_type(t.of)
    if isinstance(t, ListType):
        return T.ArrayType(_spark_type(t.item), containsNull=isinstance(t.item, OptionType))
    return T.StructType([T.StructField(n, _spark_type(x), isinstance(x, OptionType)) for n, x in t.fields])


@dataclass(frozen=True)
class RecordPlan:
    """What a record type becomes. ``root`` is its analysed structure."""

    root: StructType

    @cached_property
    def columns(self) -> list:
        return flat_columns(self.root)

    def schema(self) -> list[tuple[str, Logical]]:
        """Column names and logical types, from the declaration alone."""
        return [(c.name, c.logical) for c in self.columns]

    @cached_property
    def encode(self) -> Any:
        return encoder(self.root)

    @property
    def nested_struct(self) -> T.StructType:
        return _spark_type(self.root)

    @property
    def flat_struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, carrier(c.logical), True, {"logical": str(c.logical)}) for c in self.columns])

    def empty_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.flat_struct)

    def to_df(self, spark: SparkSession, rows: Iterable[Any]) -> DataFrame:
        """One row for each record, in order. A single record is a list of one: there is no other path."""
        rows = list(rows)
        if not rows:
            return self.empty_df(spark)
        return flatten(ingest(spark, rows, self.encode, self.nested_struct), self.columns, carried=True)

    def flatten(self, df: DataFrame) -> DataFrame:
        """A nested DataFrame, batch or streaming, as flat columns: one projection."""
        return flatten(df, self.columns)


def record(cls: type | None = None, *, runtime: Runtime | None = None, columnar: Any = None, decimal_codec: Any = None) -> Any:
    """Declare a dataclass or NamedTuple as a record. Faults are raised here, not on first use."""
    def declare(of: type) -> type:
        use = chosen(runtime, decimal_codec, columnar)
        _PLANS[of, "runtime"] = use
        if not getattr(of, "__parameters__", ()):
            _PLANS[of] = RecordPlan(Analyzer(of, use).struct())
        return of

    return declare if cls is None else declare(cls)


def plan_of(of: Any) -> RecordPlan:
    """The plan of a record class or a resolved generic such as ``R[Inner]``."""
    if of not in _PLANS:
        origin, args = typing.get_origin(of) or of, typing.get_args(of)
        use = _PLANS.get((origin, "runtime")) or chosen(None, None, None)
        parameters = dict(zip(origin.__parameters__, args, strict=True)) if args else {}
        _PLANS[of] = RecordPlan(Analyzer(origin, use, parameters).struct())
    return _PLANS[of]


def to_df(spark: SparkSession, rows: Iterable[Any], of: Any = None) -> DataFrame:
    """Records to a flat DataFrame; ``of`` names the type where rows are empty or generic."""
    rows = list(rows)
    if of is None and not rows:
        raise ValueError("an empty list needs its record type")
    return plan_of(of or type(rows[0])).to_df(spark, rows)
