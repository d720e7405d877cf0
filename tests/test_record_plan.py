"""Declarations: schemas, names, diagnostics. No Spark."""

from __future__ import annotations

import collections
import datetime as dt
import decimal as _decimal
import enum
from dataclasses import dataclass
from typing import Annotated, Generic, NamedTuple, Optional, TypeVar

import pytest

from recfold import RecordError, Runtime, as_binary, as_str, as_string, decimal, plan_of, record, skip, time_unit
from recfold.types import BINARY, I32, I64, I128, STRING, U8, U64, Box, ChronoDuration, DateTimeTz, Datetime, Decimal, Duration, List, Logical, NonZero, StdDuration, Unit, USize

T = TypeVar("T")
INT32, INT64, UINT64 = Logical("Int32"), Logical("Int64"), Logical("UInt64")


@record
@dataclass
class Inner:
    inner_id: U64
    label: str


@record
@dataclass
class Mixed:
    id: U64
    maybe_id: Optional[U64]
    ids: list[U64]
    maybe_ids: Optional[list[U64]]
    ids_with_nulls: list[Optional[U64]]
    nested: Inner
    maybe_nested: Optional[Inner]
    nested_list: list[Inner]
    tuple: tuple[U64, str]
    tuple_list: list[tuple[U64, Optional[str]]]


@record
@dataclass
class Deep:
    a: list[list[Inner]]
    b: tuple[list[I32], Optional[str]]
    c: list[Optional[tuple[list[I32], str]]]
    d: Optional[Optional[I32]]
    e: Box[I64]


class Pair(NamedTuple):
    x: I32
    gone: Annotated[object, skip]
    y: str


class Color(enum.Enum):
    RED = "red"


class Gen(Generic[T]):
    pass


def schema(hint):
    made = type("One", (), {"__annotations__": {"f": hint}})
    return plan_of(record(dataclass(made))).schema()


def rule(hint) -> str:
    with pytest.raises(RecordError) as e:
        schema(hint)
    return e.value.rule


def test_mixed_row_has_fifteen_columns_in_order():
    assert plan_of(Mixed).schema() == [
        ("id", UINT64), ("maybe_id", UINT64), ("ids", List(UINT64)), ("maybe_ids", List(UINT64)), ("ids_with_nulls", List(UINT64)), ("nested.inner_id", UINT64), ("nested.label", STRING), ("maybe_nested.inner_id", UINT64),
        ("maybe_nested.label", STRING), ("nested_list.inner_id", List(UINT64)), ("nested_list.label", List(STRING)), ("tuple.field_0", UINT64), ("tuple.field_1", STRING), ("tuple_list.field_0", List(UINT64)), ("tuple_list.field_1", List(STRING)),
    ]


def test_deeper_shapes():
    assert plan_of(Deep).schema() == [
        ("a.inner_id", List(List(UINT64))), ("a.label", List(List(STRING))), ("b.field_0", List(INT32)), ("b.field_1", STRING), ("c.field_0", List(List(INT32))), ("c.field_1", List(STRING)), ("d", INT32), ("e", INT64),
    ]


def test_tuple_struct_keeps_its_places_when_one_is_skipped():
    assert plan_of(record(Pair)).schema() == [("field_0", INT32), ("field_2", STRING)]


@pytest.mark.parametrize(
    ("hint", "logical"),
    [
        (I128, Logical("Int128")), (USize, UINT64), (NonZero[I32], INT32), (DateTimeTz, Datetime("ms")), (dt.datetime, Datetime("ms")), (Annotated[dt.datetime, time_unit("ns")], Datetime("ns")), (dt.date, Logical("Date")), (dt.time, Logical("Time")),
        (StdDuration, Duration("ns")), (Annotated[ChronoDuration, time_unit("us")], Duration("us")), (_decimal.Decimal, Decimal(38, 10)), (Annotated[_decimal.Decimal, decimal(precision=10, scale=2)], Decimal(10, 2)), (list[U8], List(Logical("UInt8"))),
        (Annotated[list[U8], as_binary], BINARY), (Annotated[bytes, as_binary], BINARY), (Annotated[list[list[U8]], as_binary], List(BINARY)), (Annotated[Color, as_str], STRING), (Annotated[list[Optional[float]], as_string], List(STRING)), (Annotated[Inner, as_string], STRING),
    ],
)
def test_leaf_types(hint, logical):
    assert schema(hint) == [("f", logical)]


@pytest.mark.parametrize(
    ("hint", "broken"),
    [
        (Color, "V1"), (I32 | str, "V1"), (dict[str, I32], "V2"), (set[I32], "V2"), (collections.deque, "V2"), (dt.timedelta, "V3"), (Unit, "V6"), (None, "V6"), (Optional[tuple[tuple[I32, str], bool]], "V8"), (tuple[Optional[tuple[I32, str]], bool], "V8"),
        (list[tuple[tuple[I32, str], bool]], "V8"), (tuple[I32, ...], "V8"), (Annotated[tuple[I32, str], as_string], "V9"), (Annotated[I32, "rename"], "V10"), (Annotated[str, as_str, as_string], "V11"), (Annotated[str, skip, as_string], "V11"), (Annotated[str, as_str, as_str], "V11"),
        (Annotated[I32, decimal(precision=4, scale=2)], "V13"), (Annotated[I32, time_unit("ms")], "V15"), (Annotated[dt.date, time_unit("ms")], "V15"), (Annotated[dt.time, time_unit("ms")], "V15"), (Annotated[I32, as_str], "V16"), (Annotated[StdDuration, as_string], "V17"),
        (Annotated[bytes, as_string], "V17"), (Annotated[U8, as_binary], "V18"), (Annotated[Optional[U8], as_binary], "V18"), (Annotated[list[Optional[U8]], as_binary], "V18"), (Annotated[list[I32], as_binary], "V18"), (Annotated[str, as_binary], "V18"), (bytes, "V19"),
        (tuple[bytes, I32], "V19"), (Annotated[Inner, as_str], "V20"), (Gen, "V20"),
    ],
)
def test_rejected(hint, broken):
    assert rule(hint) == broken


@pytest.mark.parametrize("bad", [{"precision": 0, "scale": 0}, {"precision": 39, "scale": 1}, {"precision": 4, "scale": 5}, {"precision": 4}])
def test_decimal_arguments(bad):
    with pytest.raises(RecordError) as e:
        decimal(**bad)
    assert e.value.rule == "V12"


def test_unit_text():
    with pytest.raises(RecordError) as e:
        time_unit("s")
    assert e.value.rule == "V14"


def test_enum_and_plain_class_are_no_records():
    for bad in (Color, int):
        with pytest.raises(RecordError) as e:
            record(bad)
        assert e.value.rule == "V1"


@dataclass
class Loop:
    more: list[Loop]


@dataclass
class Left:
    right: Optional[Right]


@dataclass
class Right:
    left: Optional[Left]


@pytest.mark.parametrize("bad", [Loop, Left])
def test_recursion_is_found(bad):
    with pytest.raises(RecordError) as e:
        record(bad)
    assert e.value.rule == "V7"


def test_columnar_needs_its_runtime():
    with pytest.raises(RecordError) as e:
        record(columnar=object())(dataclass(type("X", (), {"__annotations__": {"a": int}})))
    assert e.value.rule == "V21"
    record(columnar=object(), runtime=Runtime())(dataclass(type("X", (), {"__annotations__": {"a": int}})))
