"""What a user can plug in: decimal codecs, hand-written records, and a runtime that gives all roles.

Codecs are found by type in a registry, never by a method that a value happens to have.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .errors import EncodeError, RecordError
from .types import INTEGERS, Logical

RANGES = {kind: (least, most) for kind, least, most, _ in INTEGERS.values()}


def half_even_mantissa(value: decimal.Decimal, scale: int) -> int | None:
    """The value times 10 ** scale, half to even; None if the scale is out of range or the value isn't finite."""
    if not 0 <= scale <= 38 or not value.is_finite():
        return None
    sign, digits, exponent = value.as_tuple()
    magnitude, shift = int("".join(map(str, digits)) or "0"), exponent + scale
    if shift >= 0:
        magnitude *= 10**shift
    else:
        magnitude, rest = divmod(magnitude, 10**-shift)
        half = 5 * 10 ** (-shift - 1)
        magnitude += rest > half or rest == half and magnitude % 2
    return None if magnitude >= 1 << 127 else -magnitude if sign else magnitude


def fits(value: Any, logical: Logical) -> bool:
    """Whether a value is what carries a logical type."""
    kind = logical.kind
    if kind == "List":
        return isinstance(value, (list, tuple)) and all(x is None or fits(x, logical.args[0]) for x in value)
    if limits := RANGES.get(kind):
        if isinstance(value, bool):
            return False
        if "128" in kind:
            return isinstance(value, str) and value.lstrip("-").isdigit() and limits[0] <= int(value) <= limits[1]
        return isinstance(value, (int, decimal.Decimal)) and value == int(value) and limits[0] <= value <= limits[1]
    if kind in ("Datetime", "Duration"):
        return type(value) is (int if logical.args[0] == "ns" else dt.datetime if kind == "Datetime" else dt.timedelta)
    if kind == "Date":
        return isinstance(value, dt.date) and not isinstance(value, dt.datetime)
    carried = {"Boolean": bool, "String": str, "Binary": (bytes, bytearray), "Time": int, "Float32": (float,), "Float64": (float,), "Decimal": decimal.Decimal}
    return isinstance(value, carried[kind]) and (kind == "Boolean" or not isinstance(value, bool))


@dataclass
class ManualRecord:
    """A record whose schema and encoding are written by hand."""

    schema: Callable[[], list[tuple[str, Logical]]]
    encode: Callable[[list[Any]], list[tuple]]

    def rows(self, values: list[Any]) -> list[tuple]:
        """One tuple per value of a batch, checked against the batch's height and the declared schema's width and types."""
        made = self.encode(values)
        if len(made) != len(values):
            raise EncodeError(f"encoded height {len(made)} differs from the input's {len(values)}")
        declared = self.schema()
        for row in made:
            if len(row) != len(declared):
                raise EncodeError(f"encoded width {len(row)} differs from the declared schema's {len(declared)}")
            for value, (name, logical) in zip(row, declared, strict=True):
                if value is not None and not fits(value, logical):
                    raise EncodeError(f"dtype mismatch: column {name} is declared {logical} and holds {value!r}")
        return made


@dataclass
class Runtime:
    """Decimal codecs by type (value, scale) -> mantissa or None, and hand-written records by type."""

    decimals: dict[type, Callable[[Any, int], int | None]] = field(default_factory=dict)
    records: dict[type, ManualRecord] = field(default_factory=dict)

    def register_decimal(self, of: type, codec: Callable[[Any, int], int | None]) -> None:
        self.decimals[of] = codec

    def register_record(self, of: type, schema: Callable[[], list[tuple[str, Logical]]], encode: Callable[[list[Any]], list[tuple]]) -> None:
        self.records[of] = ManualRecord(schema, encode)

    def codec(self, of: type) -> Callable[[Any, int], int | None] | None:
        return next((self.decimals[t] for t in of.__mro__ if t in self.decimals), None)


DEFAULT = Runtime(decimals={decimal.Decimal: half_even_mantissa})


def chosen(runtime: Runtime | None, decimal_codec: Callable | None, columnar: Any) -> Runtime:
    """The runtime of a record: the default, an override, or an override with one role replaced."""
    if columnar is not None and runtime is None:
        raise RecordError("V21", "a columnar override needs its runtime")
    base = runtime or DEFAULT
    if decimal_codec is None:
        return base
    return Runtime({**base.decimals, object: decimal_codec}, base.records)
