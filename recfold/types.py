"""Logical types of columns, and the names by which record fields declare them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Annotated, Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class Logical:
    """A column's type apart from what carries it in Spark."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        return f"{self.kind}({', '.join(map(str, self.args))})" if self.args else self.kind


def List(inner: Logical) -> Logical:  # noqa: N802
    return Logical("List", (inner,))


BOOLEAN, STRING, BINARY, DATE, TIME = (Logical(k) for k in ("Boolean", "String", "Binary", "Date", "Time"))


def Datetime(unit: str = "ms") -> Logical:  # noqa: N802
    return Logical("Datetime", (unit,))


def Duration(unit: str = "ns") -> Logical:  # noqa: N802
    return Logical("Duration", (unit,))


def Decimal(precision: int = 38, scale: int = 10) -> Logical:  # noqa: N802
    return Logical("Decimal", (precision, scale))


#: Whole-number leaves: logical kind, least and greatest value, carrier.
INTEGERS = {
    **{f"i{b}": (f"Int{b}", -(1 << b - 1), (1 << b - 1) - 1, t) for b, t in ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType()), (128, T.StringType()))},
    **{f"u{b}": (f"UInt{b}", 0, (1 << b) - 1, t) for b, t in ((8, T.ShortType()), (16, T.IntegerType()), (32, T.LongType()), (64, T.DecimalType(20, 0)), (128, T.StringType()))},
}
INTEGERS |= {"isize": INTEGERS["i64"], "usize": INTEGERS["u64"]}


def carrier(logical: Logical) -> T.DataType:
    """The Spark type that holds a logical type without loss.

    128-bit integers are text, as 38 digits are too few. Nanosecond times are whole numbers, as Spark's
    own end at microseconds.
    """
    kind, args = logical.kind, logical.args
    if kind == "List":
        return T.ArrayType(carrier(args[0]))
    if kind == "Decimal":
        return T.DecimalType(*args)
    if kind == "Datetime":
        return T.LongType() if args[0] == "ns" else T.TimestampNTZType()
    if kind == "Duration":
        return T.LongType() if args[0] == "ns" else T.DayTimeIntervalType()
    plain = {"Boolean": T.BooleanType(), "String": T.StringType(), "Binary": T.BinaryType(), "Date": T.DateType(), "Time": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType()}
    return plain.get(kind) or next(t for k, _, _, t in INTEGERS.values() if k == kind)


@dataclass(frozen=True)
class Leaf:
    """Marks a Python type as a leaf: name is that of an integer or float, or of a time kind."""

    name: str
    nonzero: bool = False


@dataclass(frozen=True)
class Pointer:
    """Marks a type that is looked through."""


I8, I16, I32, I64, I128 = (Annotated[int, Leaf(f"i{b}")] for b in (8, 16, 32, 64, 128))
U8, U16, U32, U64, U128 = (Annotated[int, Leaf(f"u{b}")] for b in (8, 16, 32, 64, 128))
ISize, USize = Annotated[int, Leaf("isize")], Annotated[int, Leaf("usize")]
F32, F64 = Annotated[float, Leaf("f32")], Annotated[float, Leaf("f64")]
DateTimeTz = Annotated[dt.datetime, Leaf("datetime_tz")]
StdDuration = Annotated[dt.timedelta, Leaf("std_duration")]
ChronoDuration = Annotated[dt.timedelta, Leaf("chrono_duration")]


class NonZero:
    """NonZero[I32]: the integer, never zero."""

    def __class_getitem__(cls, of: Any) -> Any:
        (leaf,) = of.__metadata__
        return Annotated[int, Leaf(leaf.name, nonzero=True)]


class Box:
    """Box[T]: T, looked through. Rc, Arc, Cow and Ref are the same."""

    def __class_getitem__(cls, of: Any) -> Any:
        return Annotated[of, Pointer()]


Rc = Arc = Cow = Ref = Box


class Unit:
    """A payload without columns."""
