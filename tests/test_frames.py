"""Records to DataFrames: exact values, nulls, empty frames, streams, and a plain reference flattener."""

from __future__ import annotations

import datetime as dt
import decimal as _decimal
from dataclasses import dataclass, fields
from typing import Annotated, Generic, Optional, TypeVar

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recfold import EncodeError, Runtime, as_binary, as_string, decimal, plan_of, record, time_unit, to_df
from recfold.plans.queries import QUERIES
from recfold.streaming import flatten_stream
from recfold.types import I32, I64, U8, U64, U128, Logical, StdDuration, Unit

T = TypeVar("T")


@record
@dataclass
class Inner:
    n: I32
    s: Optional[str]


@record
@dataclass
class Shapes:
    id: I32
    one: Inner
    maybe: Optional[Inner]
    many: list[Inner]
    some: Optional[list[Optional[Inner]]]
    grid: list[list[Inner]]
    holes: list[Optional[list[I32]]]
    pair: tuple[I32, str]
    pairs: list[Optional[tuple[list[I32], Optional[str]]]]


@record
@dataclass
class Leaves:
    d: Annotated[_decimal.Decimal, decimal(precision=10, scale=2)]
    ms: dt.datetime
    ns: Annotated[dt.datetime, time_unit("ns")]
    t: dt.time
    dur: Annotated[StdDuration, time_unit("us")]
    raw: Annotated[list[U8], as_binary]
    big: U128
    u: U64
    f: Annotated[float, as_string]


@record
@dataclass
class Nothing:
    pass


@record
@dataclass
class Holder(Generic[T]):
    id: I32
    payload: T


ROWS = [
    Shapes(1, Inner(1, "a"), None, [Inner(1, "x"), Inner(2, None)], None, [[Inner(1, "g")], []], [None, [1]], (1, "p"), [None, ([1, 2], None)]),
    Shapes(2, Inner(2, None), Inner(3, "b"), [], [None, Inner(4, "c")], [], [], (2, "q"), []),
    Shapes(3, Inner(3, "z"), None, [Inner(9, "y")], [], [[]], [[]], (3, "r"), [([], "e")]),
]
FLAT = [
    (1, 1, "a", None, None, [1, 2], ["x", None], None, None, [[1], []], [["g"], []], [None, [1]], 1, "p", [None, [1, 2]], [None, None]),
    (2, 2, None, 3, "b", [], [], [None, 4], [None, "c"], [], [], [], 2, "q", [], []),
    (3, 3, "z", None, None, [9], ["y"], [], [], [[]], [[]], [[]], 3, "r", [[]], ["e"]),
]


def test_shapes(spark):
    df = to_df(spark, ROWS)
    assert [tuple(r) for r in df.collect()] == FLAT
    assert df.columns == [n for n, _ in plan_of(Shapes).schema()]
    assert [f.metadata["logical"] for f in df.schema] == [str(t) for _, t in plan_of(Shapes).schema()]


def test_single_row_is_a_batch_of_one(spark):
    assert [tuple(r) for r in to_df(spark, ROWS[:1]).collect()] == FLAT[:1]


def test_absent_batches_stay_typed(spark):
    df = to_df(spark, [ROWS[0]]).select("`maybe.n`", "`some.s`")
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "array<string>"]
    empty = plan_of(Shapes).to_df(spark, [])
    assert empty.count() == 0 and [f.dataType for f in empty.schema] == [f.dataType for f in plan_of(Shapes).flat_struct]


def test_leaves(spark):
    row = Leaves(_decimal.Decimal("1.005"), dt.datetime(2020, 1, 1, 0, 0, 0, 123_456), dt.datetime(1970, 1, 1, 0, 0, 1), 86_399_999_999_999, dt.timedelta(microseconds=1_500_000), [0, 255], 2**128 - 1, 2**64 - 1, 1e20)
    assert tuple(to_df(spark, [row]).first()) == (
        _decimal.Decimal("1.00"), dt.datetime(2020, 1, 1, 0, 0, 0, 123_000), 1_000_000_000, 86_399_999_999_999, dt.timedelta(seconds=1.5), b"\x00\xff", str(2**128 - 1), _decimal.Decimal(2**64 - 1), "100000000000000000000",
    )


def test_none_in_a_bare_field_is_an_error(spark):
    with pytest.raises(EncodeError):
        to_df(spark, [Shapes(None, *[getattr(ROWS[0], f.name) for f in fields(Shapes)][1:])])
    with pytest.raises(EncodeError):
        to_df(spark, [Shapes(1, None, *[getattr(ROWS[0], f.name) for f in fields(Shapes)][2:])])


def test_no_columns_keep_the_height(spark):
    assert to_df(spark, [Nothing(), Nothing()]).count() == 2
    unit = plan_of(Holder[Unit]).to_df(spark, [Holder(1, Unit()), Holder(2, Unit())])
    assert unit.columns == ["id"] and unit.count() == 2


def test_generics_and_manual_records(spark):
    class Point:
        def __init__(self, x):
            self.x = x

    runtime = Runtime()
    runtime.register_record(Point, lambda: [("x", Logical("Int64")), ("twice", Logical("Int64"))], lambda rows: [(p.x, 2 * p.x) for p in rows])
    made = record(runtime=runtime)(dataclass(type("Own", (), {"__annotations__": {"id": I64, "p": Optional[Point]}})))
    assert [tuple(r) for r in to_df(spark, [made(1, Point(4)), made(2, None)]).collect()] == [(1, 4, 8), (2, None, None)]
    df = plan_of(Holder[Inner]).to_df(spark, [Holder(1, Inner(2, "s"))])
    assert df.columns == ["id", "payload.n", "payload.s"] and tuple(df.first()) == (1, 2, "s")


def test_flatten_rounds_half_even_and_shows_floats(spark):
    nested = spark.sql("SELECT cast(1.005 as decimal(9,3)) d, timestamp_ntz'2020-01-01 00:00:00.123456' ms, timestamp_ntz'1970-01-01 00:00:01' ns, 5L t, interval '1' second dur, array(0S, 255S) raw, '1' big, cast(1 as decimal(20,0)) u, 1.5E20D f")
    row = plan_of(Leaves).flatten(nested).first()
    assert (row.d, row.ms, row.ns, row.raw, row.f) == (_decimal.Decimal("1.00"), dt.datetime(2020, 1, 1, 0, 0, 0, 123_000), 1_000_000_000, b"\x00\xff", "150000000000000000000")
    shown = record(dataclass(type("Shown", (), {"__annotations__": {"f": Annotated[float, as_string]}})))
    values = spark.sql("SELECT explode(array(1D, 1.25D, 1E-7D, 1.5E-10D, 1E7D, 12345678.5D, -2.5E9D)) f")
    assert [r.f for r in plan_of(shown).flatten(values).collect()] == ["1", "1.25", "0.0000001", "0.00000000015", "10000000", "12345678.5", "-2500000000"]


def test_flatten_is_one_projection_that_prunes_the_scan(spark, tmp_path):
    plan_of(Shapes)
    nested = spark.createDataFrame([(1, [(1, "a")])], "id int, many array<struct<n:int,s:string>>")
    nested.write.parquet(str(tmp_path / "t"))
    only = record(dataclass(type("Only", (), {"__annotations__": {"many": list[Inner]}})))
    plan = plan_of(only).flatten(spark.read.parquet(str(tmp_path / "t"))).select("`many.n`")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<many:array<struct<n:int>>>" in plan


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, (2, "a")), (2, None)], "id int, payload struct<n:int,s:string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, payload struct<n:int,s:string>").parquet(str(tmp_path / "in"))
    query = flatten_stream(stream, Holder[Inner]).writeStream.format("memory").queryName("flat").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("flat").collect())) == [(1, 2, "a"), (2, None, None)]
    with pytest.raises(ValueError):
        flatten_stream(spark.range(1), Holder[Inner])


inner = st.builds(Inner, st.integers(-5, 5), st.none() | st.text("ab", max_size=2))
shapes = st.builds(
    Shapes, st.integers(0, 9), inner, st.none() | inner, st.lists(inner, max_size=3), st.none() | st.lists(st.none() | inner, max_size=3), st.lists(st.lists(inner, max_size=2), max_size=2),
    st.lists(st.none() | st.lists(st.integers(0, 3), max_size=2), max_size=2), st.tuples(st.integers(0, 3), st.text("xy", max_size=2)), st.lists(st.none() | st.tuples(st.lists(st.integers(0, 3), max_size=2), st.none() | st.just("k")), max_size=2),
)


def plain(r: Shapes) -> tuple:
    get = lambda v, name: None if v is None else getattr(v, name)
    out = [r.id]
    out += [r.one.n, r.one.s, get(r.maybe, "n"), get(r.maybe, "s")]
    out += [[x.n for x in r.many], [x.s for x in r.many]]
    out += [None if r.some is None else [get(x, c) for x in r.some] for c in ("n", "s")]
    out += [[[getattr(x, c) for x in row] for row in r.grid] for c in ("n", "s")]
    out += [r.holes, *r.pair]
    out += [[None if p is None else p[i] for p in r.pairs] for i in (0, 1)]
    return tuple(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(shapes, min_size=1, max_size=5))
def test_against_plain_flattening(spark, rows):
    assert [tuple(r) for r in to_df(spark, rows).collect()] == [plain(r) for r in rows]


def test_queries_run(spark):
    for name in ("orders_items_lists", "customer_orders_items", "unit_payload", "empty_frame"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
    assert QUERIES["empty_frame"](spark, "").select(F.count("*")).first()[0] == 0
