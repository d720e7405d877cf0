"""Python values to what carries them: range checks, rescaling, time units, display text."""

from __future__ import annotations

import datetime as dt
import decimal
import enum
from collections.abc import Callable
from typing import Any

from ..errors import EncodeError
from ..types import INTEGERS, Leaf

EPOCH = dt.datetime(1970, 1, 1)
#: Nanoseconds in a unit.
NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000}
_I64 = range(-(1 << 63), 1 << 63)
_EXACT = decimal.Context(prec=120)


def integer(leaf: Leaf) -> Callable[[Any], Any]:
    kind, least, most, _ = INTEGERS[leaf.name]

    def encode(value: Any) -> Any:
        if isinstance(value, bool) or not isinstance(value, int):
            raise EncodeError(f"{kind} can't hold {value!r}")
        if not least <= value <= most:
            raise EncodeError(f"{value} is out of range for {kind}")
        if leaf.nonzero and value == 0:
            raise EncodeError(f"a non-zero {kind} can't hold 0")
        return str(value) if "128" in kind else decimal.Decimal(value) if kind == "UInt64" else value

    return encode


def real(value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise EncodeError(f"a float can't hold {value!r}")
    return float(value)


def boolean(value: Any) -> bool:
    if not isinstance(value, bool):
        raise EncodeError(f"Boolean can't hold {value!r}")
    return value


def text(value: Any) -> str:
    """The string that a value is or, by hook or enum, stands for. Nothing is formatted."""
    if isinstance(value, enum.Enum):
        value = value.value
    if isinstance(value, str):
        return str(value)
    hook = getattr(type(value), "as_str", None)
    if hook is None:
        raise EncodeError(f"{value!r} is no string and has no as_str")
    return hook(value)


def binary(value: Any) -> bytes:
    """Bytes, or a list of numbers that are bytes."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)
    if not isinstance(value, (list, tuple)) or any(isinstance(x, bool) or not isinstance(x, int) or not 0 <= x < 256 for x in value):
        raise EncodeError(f"Binary can't hold {value!r}")
    return bytes(value)


def date(value: Any) -> dt.date:
    if not isinstance(value, dt.date) or isinstance(value, dt.datetime):
        raise EncodeError(f"Date can't hold {value!r}")
    return value


def rescaled(precision: int, scale: int, codec: Callable[[Any, int], int | None]) -> Callable[[Any], decimal.Decimal]:
    """Half-even rescaling by a codec; the precision is checked here."""

    def encode(value: Any) -> decimal.Decimal:
        mantissa = codec(value, scale)
        if mantissa is None:
            raise EncodeError(f"{value!r} can't be rescaled to scale {scale}")
        if abs(mantissa) >= 10**precision:
            raise EncodeError(f"{value!r} needs more than {precision} digits at scale {scale}")
        return decimal.Decimal(mantissa).scaleb(-scale, _EXACT)

    return encode


def _checked(value: int, what: str) -> int:
    if value not in _I64:
        raise EncodeError(f"{what} {value} is out of range")
    return value


def _epoch_nanos(value: dt.datetime | int) -> int:
    if isinstance(value, int):
        return value
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    delta = value - EPOCH
    return ((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds) * 1_000


def datetime_in(unit: str) -> Callable[[Any], Any]:
    """UTC instants, floored to the unit. A whole number is nanoseconds since 1970."""

    def encode(value: dt.datetime | int) -> Any:
        nanos = _epoch_nanos(value)
        if unit == "ns":
            return _checked(nanos, "datetime in ns")
        return EPOCH + dt.timedelta(microseconds=nanos // NANOS[unit] * NANOS[unit] // 1_000)

    return encode


def time_of_day(value: dt.time | int) -> int:
    """Nanoseconds of the day."""
    if isinstance(value, int):
        if not 0 <= value < 86_400_000_000_000:
            raise EncodeError(f"{value} is no nanosecond of a day")
        return value
    return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000_000 + value.microsecond * 1_000


def duration_in(unit: str, signed: bool) -> Callable[[Any], Any]:
    """Truncated toward zero. A whole number is nanoseconds."""

    def encode(value: dt.timedelta | int) -> Any:
        nanos = value if isinstance(value, int) else ((value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds) * 1_000
        if nanos < 0 and not signed:
            raise EncodeError(f"{value!r} is negative")
        whole = abs(nanos) // NANOS[unit] * (-1 if nanos < 0 else 1)
        _checked(whole, f"duration in {unit}")
        return whole if unit == "ns" else dt.timedelta(microseconds=whole * NANOS[unit] // 1_000)

    return encode


def _fraction(nanos: int) -> str:
    for digits in (0, 3, 6, 9):
        if nanos % 10 ** (9 - digits) == 0:
            return f".{nanos // 10 ** (9 - digits):0{digits}d}" if digits else ""
    return ""


def display(value: Any) -> str:
    """Display text: no exponents, ``1`` for 1.0, lower-case booleans. A failing ``__str__`` is an error, not a null."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "NaN" if value != value else "inf" if value > 0 else "-inf"
        out = format(decimal.Decimal(repr(value)), "f")
        return out[:-2] if out.endswith(".0") else out
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, dt.datetime):
        body = f"{value:%Y-%m-%d %H:%M:%S}{_fraction(value.microsecond * 1_000)}"
        return body if value.tzinfo is None else body + (" UTC" if value.utcoffset() == dt.timedelta(0) else f" {value:%:z}")
    if isinstance(value, dt.time):
        return f"{value:%H:%M:%S}{_fraction(value.microsecond * 1_000)}"
    if isinstance(value, dt.timedelta):
        micros = (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds
        whole, rest = divmod(abs(micros), 1_000_000)
        shown = f"{whole}.{rest:06d}".rstrip("0").rstrip(".")
        return f"{'-' if micros < 0 else ''}PT{shown}S" if micros else "P0D"
    if isinstance(value, enum.Enum) and isinstance(value.value, str):
        value = value.value
    try:
        return str(value)
    except Exception as e:
        raise EncodeError(f"display of a {type(value).__name__} failed: {e}") from e
