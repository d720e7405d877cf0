"""Leaf rules on columns: the same results as on values, whatever the session's time zone."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass
from typing import Annotated

import pytest

from recfold import EncodeError, Runtime, as_binary, as_string, decimal as decimal_field, plan_of, record, time_unit, to_df
from recfold.functions import encode
from recfold.runtime import ManualRecord
from recfold.types import I64, STRING, U8, U64, ChronoDuration, DateTimeTz, List, Logical, NonZero, StdDuration


@record
@dataclass
class Zoned:
    ms: DateTimeTz
    us: Annotated[DateTimeTz, time_unit("us")]
    ns: Annotated[DateTimeTz, time_unit("ns")]
    shown: Annotated[DateTimeTz, as_string]


@record
@dataclass
class Naive:
    ms: dt.datetime
    us: Annotated[dt.datetime, time_unit("us")]
    ns: Annotated[dt.datetime, time_unit("ns")]
    shown: Annotated[dt.datetime, as_string]


@record
@dataclass
class Spans:
    ns: ChronoDuration
    us: Annotated[ChronoDuration, time_unit("us")]
    ms: Annotated[ChronoDuration, time_unit("ms")]
    shown: Annotated[ChronoDuration, as_string]


@record
@dataclass
class Std:
    span: StdDuration


@record
@dataclass
class Times:
    at: dt.time


@record
@dataclass
class Numbers:
    small: U8
    nonzero: NonZero[I64]
    large: U64
    bits: Annotated[list[U8], as_binary]


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(request, spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", old)


#: Instants and local times, some of which a change of the clock skips or repeats in New York.
INSTANTS = ["2024-07-01 12:00:00.123456", "2024-03-10 07:30:00.5", "2024-11-03 05:30:00", "2024-11-03 06:30:00", "1969-12-31 23:59:59.999999", "2024-03-10 02:30:00.120"]


def test_instants_are_utc(spark, zone):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(INSTANTS)], "i int, t string").selectExpr("i", "CAST(concat(t, 'Z') AS TIMESTAMP) AS t").orderBy("i")
    got = plan_of(Zoned).flatten(df.selectExpr("t AS ms", "t AS us", "t AS ns", "t AS shown")).collect()
    for r, x in zip(got, map(dt.datetime.fromisoformat, INSTANTS), strict=True):
        nanos = encode.datetime_in("ns")(x)
        assert (r.ms, r.us, r.ns) == (encode.datetime_in("ms")(x), x, nanos)
        assert r.shown == encode.display(x.replace(tzinfo=dt.UTC))


def test_local_times_stay(spark, zone):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(INSTANTS)], "i int, t string").selectExpr("i", "CAST(t AS TIMESTAMP_NTZ) AS t").orderBy("i")
    got = plan_of(Naive).flatten(df.selectExpr("t AS ms", "t AS us", "t AS ns", "t AS shown")).collect()
    for r, x in zip(got, map(dt.datetime.fromisoformat, INSTANTS), strict=True):
        assert (r.ms, r.us, r.ns, r.shown) == (encode.datetime_in("ms")(x), x, encode.datetime_in("ns")(x), encode.display(x))


def test_durations(spark):
    spans = [dt.timedelta(seconds=1.5), dt.timedelta(microseconds=-1501), dt.timedelta(0), dt.timedelta(days=-3, microseconds=7), dt.timedelta(days=40_000), dt.timedelta(microseconds=999)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(spans)], "i int, t interval day to second").orderBy("i")
    got = plan_of(Spans).flatten(df.selectExpr("t AS ns", "t AS us", "t AS ms", "t AS shown")).collect()
    want = [(encode.duration_in("ns", True)(x), x, encode.duration_in("ms", True)(x), encode.display(x)) for x in spans]
    assert [tuple(r) for r in got] == want
    nanos = spark.range(1).selectExpr("-1999999L AS ns", "-1999999L AS us", "-1999999L AS ms", "CAST(null AS string) AS shown")
    assert tuple(plan_of(Spans).flatten(nanos).first())[:3] == (-1_999_999, dt.timedelta(microseconds=-1999), dt.timedelta(milliseconds=-1))
    with pytest.raises(Exception, match="negative"):
        plan_of(Std).flatten(spark.createDataFrame([(dt.timedelta(seconds=-1),)], "span interval day to second")).collect()


def test_times_of_day(spark):
    assert plan_of(Times).flatten(spark.range(1).selectExpr("86399999999999L AS at")).first().at == 86_399_999_999_999
    with pytest.raises(Exception, match="nanosecond of a day"):
        plan_of(Times).flatten(spark.range(1).selectExpr("86400000000000L AS at")).collect()
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        df = spark.sql("SELECT TIME '12:00:00' AS at UNION ALL SELECT TIME '23:59:59.999999'")
        assert sorted(r.at for r in plan_of(Times).flatten(df).collect()) == [43_200_000_000_000, 86_399_999_999_000]
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")


@pytest.mark.parametrize(
    ("small", "nonzero", "large", "bits"),
    [("300", "1", "1", "array(1)"), ("-5", "1", "1", "array(1)"), ("1", "0", "1", "array(1)"), ("1", "1", "-1", "array(1)"), ("1", "1", "18446744073709551616", "array(1)"), ("1", "1", "1", "array(1, null, 3)"), ("1", "1", "1", "array(256)")],
)
def test_numbers_out_of_range_are_errors(spark, small, nonzero, large, bits):
    rows = "SELECT CAST({} AS INT) AS small, CAST({} AS BIGINT) AS nonzero, CAST({} AS DECIMAL(38,0)) AS large, {} AS bits"
    good = plan_of(Numbers).flatten(spark.sql(rows.format(255, -7, 2**64 - 1, "array(0, 255)"))).first()
    assert tuple(good) == (255, -7, decimal.Decimal(2**64 - 1), b"\x00\xff")
    with pytest.raises(Exception, match="out of range|no byte"):
        plan_of(Numbers).flatten(spark.sql(rows.format(small, nonzero, large, bits))).collect()


def test_values_of_the_wrong_kind_are_errors():
    for bad in (5, "x", [256], [None], [True]):
        with pytest.raises(EncodeError):
            encode.binary(bad)
    assert encode.binary([1, 255]) == encode.binary(b"\x01\xff")
    with pytest.raises(EncodeError):
        encode.date(dt.datetime(2020, 1, 1))


class Point:
    def __init__(self, x, name):
        self.x, self.name = x, name


BATCHES = []


def encode_points(points):
    BATCHES.append(len(points))
    return [(p.x, p.name, [p.name]) for p in points]


MANUAL = Runtime()
MANUAL.register_record(Point, lambda: [("x", Logical("Int64")), ("name", STRING), ("names", List(STRING))], encode_points)


@record(runtime=MANUAL)
@dataclass
class Held:
    id: I64
    point: Point
    more: list[Point]


def test_hand_written_records_see_the_whole_batch(spark):
    BATCHES.clear()
    rows = [Held(i, Point(i, "p"), [Point(-i, "q")] * (i % 3)) for i in range(10)]
    got = to_df(spark, rows).collect()
    assert [tuple(r) for r in got] == [(i, i, "p", ["p"], [-i] * (i % 3), ["q"] * (i % 3), [["q"]] * (i % 3)) for i in range(10)] and BATCHES == [10, 9]
    for bad in (Point("1", "p"), Point(1, 2), Point(2**63, "p"), Point(True, "p"), Point(1.5, "p")):
        with pytest.raises(EncodeError, match="dtype mismatch"):
            to_df(spark, [Held(1, bad, [])])
    with pytest.raises(EncodeError, match="dtype mismatch"):
        ManualRecord(lambda: [("d", Logical("Date"))], lambda rows: [(dt.datetime(2020, 1, 1),) for _ in rows]).rows([1])


@record
@dataclass
class Wide:
    id: U64
    price: Annotated[decimal.Decimal, decimal_field(precision=18, scale=2)]
    at: dt.datetime
    span: Annotated[ChronoDuration, time_unit("us")]
    maybe: list[list[str] | None] | None


def test_many_rows_are_ingested_in_batches(spark):
    rows = [Wide(i, decimal.Decimal(i) / 8, dt.datetime(2020, 1, 1, microsecond=i), dt.timedelta(microseconds=-i), [None, ["a"], []] if i % 2 else None) for i in range(25_000)]
    df = to_df(spark, rows)
    assert df.count() == 25_000 and df.dtypes == [(f.name, f.dataType.simpleString()) for f in plan_of(Wide).flat_struct]
    last = df.filter("id = 24999").first()
    assert tuple(last) == (24_999, decimal.Decimal("3124.88"), dt.datetime(2020, 1, 1, microsecond=24_000), dt.timedelta(microseconds=-24_999), [None, ["a"], []])
    assert [r.id for r in df.limit(3).collect()] == [0, 1, 2]
