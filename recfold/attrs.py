"""Field attributes, given as ``Annotated`` metadata: at most one for a field."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import RecordError

UNITS = ("ms", "us", "ns")


@dataclass(frozen=True)
class Attribute:
    name: str
    args: tuple = ()


skip = Attribute("skip")
as_string = Attribute("as_string")
as_str = Attribute("as_str")
as_binary = Attribute("as_binary")


def decimal(*, precision: int | None = None, scale: int | None = None) -> Attribute:
    """Precision and scale of a decimal field; both are needed."""
    if precision is None or scale is None:
        raise RecordError("V12", "decimal(...) needs both precision and scale")
    if not 1 <= precision <= 38:
        raise RecordError("V12", f"decimal precision must be between 1 and 38, not {precision}")
    if not 0 <= scale <= precision:
        raise RecordError("V12", f"decimal scale must be between 0 and the precision {precision}, not {scale}")
    return Attribute("decimal", (precision, scale))


def time_unit(unit: str) -> Attribute:
    """The unit of a datetime or duration field."""
    if unit not in UNITS:
        raise RecordError("V14", f"time_unit must be one of {', '.join(UNITS)}, not {unit!r}")
    return Attribute("time_unit", (unit,))


def only_attribute(field: str, metadata: list) -> Attribute | None:
    found = []
    for x in metadata:
        if not isinstance(x, Attribute):
            raise RecordError("V10", f"field {field}: unknown attribute {x!r}")
        found.append(x)
    if len(found) > 1:
        same = len({x.name for x in found}) == 1
        raise RecordError("V11", f"field {field}: {'duplicate' if same else 'conflicting'} attributes {', '.join(x.name for x in found)}")
    return found[0] if found else None
