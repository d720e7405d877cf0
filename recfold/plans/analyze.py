"""Type hints of record fields to a tree of leaves, lists, options and records."""

from __future__ import annotations

import collections
import dataclasses
import datetime as dt
import decimal as _decimal
import enum
import types as _types
import typing
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from typing import Any

from .. import attrs
from ..errors import EncodeError, RecordError
from ..functions import encode
from ..runtime import DEFAULT, Runtime
from ..types import BINARY, BOOLEAN, DATE, INTEGERS, STRING, TIME, Datetime, Decimal, Duration, Leaf, Logical, Pointer, Unit

#: Containers that have no columns, and what to use instead.
_REJECTED = {dict: "a list of key and value records", set: "a list", frozenset: "a list", collections.deque: "a list", collections.OrderedDict: "a list of key and value records", collections.defaultdict: "a list of key and value records"}
_TIMES = {"datetime_tz": "Datetime", "datetime": "Datetime", "std_duration": "Duration", "chrono_duration": "Duration"}


@dataclass(frozen=True)
class LeafType:
    """A leaf, how a value becomes what carries it, and what it must be besides: ``nonzero`` or ``unsigned``."""

    logical: Logical
    encode: Callable[[Any], Any]
    rule: str | None = None


@dataclass(frozen=True)
class ListType:
    item: Any


@dataclass(frozen=True)
class OptionType:
    """An option; options of options are one."""

    of: Any


@dataclass(frozen=True)
class StructType:
    """A record or tuple: its fields in order, and how to take one from a value."""

    name: str
    fields: tuple[tuple[str, Any], ...]
    take: tuple[Callable[[Any], Any], ...]
    manual: Any = None


def _unwrap(hint: Any) -> tuple[Any, list, Leaf | None]:
    """A hint without its metadata, the metadata that is neither leaf nor pointer, and the leaf."""
    if typing.get_origin(hint) is not typing.Annotated:
        return hint, [], None
    inner, *metadata = typing.get_args(hint)
    leaf = next((m for m in metadata if isinstance(m, Leaf)), None)
    return inner, [m for m in metadata if not isinstance(m, (Leaf, Pointer))], leaf


def _is_option(hint: Any) -> bool:
    return typing.get_origin(hint) in (typing.Union, _types.UnionType)


def is_record(t: Any) -> bool:
    return isinstance(t, type) and (dataclasses.is_dataclass(t) or issubclass(t, tuple) and hasattr(t, "_fields"))


class Analyzer:
    """Analyses the fields of one record class, with its type parameters resolved."""

    def __init__(self, owner: type, runtime: Runtime = DEFAULT, parameters: dict | None = None, above: tuple = ()):
        self.owner, self.runtime, self.parameters, self.above = owner, runtime, parameters or {}, (*above, (owner, tuple((parameters or {}).values())))

    def struct(self) -> StructType:
        if isinstance(self.owner, type) and issubclass(self.owner, enum.Enum):
            raise RecordError("V1", f"{self.owner.__name__}: an enum is no record")
        if not is_record(self.owner):
            raise RecordError("V1", f"{getattr(self.owner, '__name__', self.owner)}: a record is a dataclass or NamedTuple")
        try:
            hints = typing.get_type_hints(self.owner, include_extras=True)
        except NameError as e:
            raise RecordError("V7", f"{self.owner.__name__}: {e}; a record can't hold itself or an undefined type") from e
        fields, take = [], []
        named = [f.name for f in dataclasses.fields(self.owner)] if dataclasses.is_dataclass(self.owner) else list(self.owner._fields)
        for i, name in enumerate(named):
            found = self.field(name, hints[name])
            if found is None:
                continue
            fields.append((name if dataclasses.is_dataclass(self.owner) else f"field_{i}", found))
            take.append((lambda n: lambda v: getattr(v, n))(name))
        return StructType(self.owner.__name__, tuple(fields), tuple(take))

    def field(self, name: str, hint: Any) -> Any:
        bare, metadata, leaf = _unwrap(hint)
        attribute = attrs.only_attribute(name, metadata)
        if attribute == attrs.skip:
            return None
        hint = typing.Annotated[bare, leaf] if leaf else bare
        if bare is Unit or bare is type(None):
            raise RecordError("V6", f"field {name}: a unit has no columns and can't be a field of its own")
        return self.shape(name, hint, attribute, False)

    def shape(self, name: str, hint: Any, attribute: attrs.Attribute | None, wrapped: bool) -> Any:
        bare, metadata, leaf = _unwrap(hint)
        if metadata:
            raise RecordError("V10", f"field {name}: attributes belong to the field, not inside its type: {metadata}")
        if isinstance(bare, typing.TypeVar):
            if bare not in self.parameters:
                raise RecordError("V20", f"field {name}: type parameter {bare} isn't resolved")
            return self.shape(name, self.parameters[bare], attribute, wrapped)
        if _is_option(bare):
            args = [a for a in typing.get_args(bare) if a is not type(None)]
            if len(args) != 1 or len(args) == len(typing.get_args(bare)):
                raise RecordError("V1", f"field {name}: a union other than Optional has no columns")
            inner = self.shape(name, args[0], attribute, True)
            return inner if isinstance(inner, OptionType) else OptionType(inner)
        origin = typing.get_origin(bare) or bare
        if origin in _REJECTED:
            raise RecordError("V2", f"field {name}: {origin.__name__} isn't supported; use {_REJECTED[origin]}")
        if origin is list:
            if not typing.get_args(bare):
                raise RecordError("V2", f"field {name}: a list needs an element type")
            (item,) = typing.get_args(bare)
            if attribute == attrs.as_binary and self._is_byte(item):
                return LeafType(BINARY, encode.binary)
            return ListType(self.shape(name, item, attribute, True))
        if origin is tuple:
            return self.tuple(name, typing.get_args(bare), attribute, wrapped)
        return self.leaf(name, bare, leaf, attribute)

    @staticmethod
    def _is_byte(item: Any) -> bool:
        _, _, leaf = _unwrap(item)
        return leaf is not None and leaf.name == "u8"

    def tuple(self, name: str, items: tuple, attribute: attrs.Attribute | None, wrapped: bool) -> StructType:
        if attribute is not None:
            raise RecordError("V9", f"field {name}: {attribute.name} can't be given to a tuple; use a record")
        if not items or Ellipsis in items:
            raise RecordError("V8", f"field {name}: a tuple needs one type for each place")
        fields = []
        for i, item in enumerate(items):
            inner, _, _ = _unwrap(item)
            deeper = inner
            while _is_option(deeper) or typing.get_origin(deeper) is list:
                deeper, _, _ = _unwrap(next(a for a in typing.get_args(deeper) if a is not type(None)))
            if deeper is not inner and typing.get_origin(deeper) is tuple:
                raise RecordError("V8", f"field {name}: a tuple inside an option or list inside a tuple; use a record")
            if wrapped and typing.get_origin(inner) is tuple:
                raise RecordError("V8", f"field {name}: a nested tuple can't be wrapped; use a record")
            if inner is bytes:
                raise RecordError("V19", f"field {name}: bytes in a tuple need a record with as_binary")
            fields.append((f"field_{i}", self.shape(f"{name}.field_{i}", item, None, False)))
        return StructType("tuple", tuple(fields), tuple((lambda i: lambda v: v[i])(i) for i in range(len(items))))

    def leaf(self, name: str, bare: Any, leaf: Leaf | None, attribute: attrs.Attribute | None) -> Any:
        kind = attribute.name if attribute else None
        base = self.base(bare, leaf)
        wrong = lambda rule: RecordError(rule, f"field {name}: {kind} can't be given to {base or getattr(bare, '__name__', bare)}")
        if kind == "as_string":
            if base in ("std_duration", "bytes") or bare is object:
                raise wrong("V17")
            return LeafType(STRING, encode.display)
        if kind == "as_str":
            stringy = base == "str" or isinstance(bare, type) and (hasattr(bare, "as_str") or issubclass(bare, enum.Enum) and all(isinstance(x.value, str) for x in bare))
            if base is not None and base != "str":
                raise wrong("V16")
            if not stringy:
                raise RecordError("V20", f"field {name}: {getattr(bare, '__name__', bare)} has no as_str")
            return LeafType(STRING, encode.text)
        if kind == "as_binary":
            if base == "bytes":
                return LeafType(BINARY, encode.binary)
            raise wrong("V18")
        if kind == "decimal":
            if base is not None and base != "decimal":
                raise wrong("V13")
            codec = self.runtime.codec(bare) if isinstance(bare, type) else None
            if codec is None:
                raise RecordError("V20", f"field {name}: no decimal codec for {getattr(bare, '__name__', bare)}")
            return LeafType(Decimal(*attribute.args), encode.rescaled(*attribute.args, codec))
        if kind == "time_unit":
            if base not in _TIMES:
                raise wrong("V15")
            return self.timed(base, attribute.args[0])
        if base is None:
            return self.record(name, bare)
        if base == "bytes":
            raise RecordError("V19", f"field {name}: bytes need as_binary")
        if base == "timedelta":
            raise RecordError("V3", f"field {name}: a bare timedelta is ambiguous; use StdDuration or ChronoDuration")
        if base in INTEGERS:
            return LeafType(Logical(INTEGERS[base][0]), encode.integer(leaf or Leaf(base)), "nonzero" if leaf and leaf.nonzero else None)
        if base in _TIMES:
            return self.timed(base, "ms" if _TIMES[base] == "Datetime" else "ns")
        if base == "decimal":
            codec = self.runtime.codec(_decimal.Decimal)
            return LeafType(Decimal(), encode.rescaled(38, 10, codec))
        made = {"bool": (BOOLEAN, encode.boolean), "str": (STRING, encode.text), "f32": (Logical("Float32"), encode.real), "f64": (Logical("Float64"), encode.real), "date": (DATE, encode.date), "time": (TIME, encode.time_of_day)}
        return LeafType(*made[base])

    @staticmethod
    def timed(base: str, unit: str) -> LeafType:
        if _TIMES[base] == "Datetime":
            return LeafType(Datetime(unit), encode.datetime_in(unit))
        return LeafType(Duration(unit), encode.duration_in(unit, base == "chrono_duration"), None if base == "chrono_duration" else "unsigned")

    @staticmethod
    def base(bare: Any, leaf: Leaf | None) -> str | None:
        """The leaf kind of a type; None for what must be a record."""
        if leaf is not None:
            return leaf.name
        plain = {bool: "bool", int: "i64", float: "f64", str: "str", bytes: "bytes", bytearray: "bytes", memoryview: "bytes", dt.datetime: "datetime", dt.date: "date", dt.time: "time", dt.timedelta: "timedelta", _decimal.Decimal: "decimal"}
        return plain.get(bare)

    def record(self, name: str, hint: Any) -> StructType:
        origin, args = typing.get_origin(hint) or hint, typing.get_args(hint)
        if origin is Unit:
            return StructType("Unit", (), ())
        if origin in self.runtime.records:
            manual = self.runtime.records[origin]
            made = tuple((n, LeafType(t, lambda v: v)) for n, t in manual.schema())
            return StructType(origin.__name__, made, tuple((lambda i: lambda v: v[i])(i) for i in range(len(made))), manual)
        if isinstance(origin, type) and issubclass(origin, enum.Enum):
            raise RecordError("V1", f"field {name}: the enum {origin.__name__} has no columns; use as_string or as_str")
        if not is_record(origin):
            raise RecordError("V20", f"field {name}: {getattr(origin, '__name__', origin)} is no record and no known leaf")
        resolved = tuple(self.parameters.get(a, a) for a in args)
        if any(origin is t and resolved == p for t, p in self.above):
            raise RecordError("V7", f"field {name}: {origin.__name__} holds itself")
        parameters = dict(zip(getattr(origin, "__parameters__", ()), resolved, strict=True)) if args else {}
        return Analyzer(origin, self.runtime, parameters, self.above).struct()


def encoder(t: Any) -> Callable[[list[Any]], list[Any]]:
    """Many values of a type to nested tuples and lists of what carries them. Hand-written records see all values at once."""
    if isinstance(t, LeafType):
        return lambda values: [t.encode(v) for v in values]
    if isinstance(t, OptionType):
        inner = encoder(t.of)

        def option(values: list[Any]) -> list[Any]:
            some = iter(inner([v for v in values if v is not None]))
            return [None if v is None else next(some) for v in values]

        return option
    if isinstance(t, ListType):
        item = encoder(t.item)

        def items(values: list[Any]) -> list[Any]:
            flat = iter(item([x for v in values for x in v]))
            return [list(islice(flat, len(v))) for v in values]

        return items
    if t.manual is not None:
        return lambda values: [tuple(r) for r in t.manual.rows(values)]
    parts = [encoder(x) for _, x in t.fields]

    def struct(values: list[Any]) -> list[tuple]:
        if any(v is None for v in values):
            raise EncodeError(f"a {t.name} can't be None")
        columns = [part([take(v) for v in values]) for part, take in zip(parts, t.take, strict=True)]
        return list(zip(*columns, strict=True)) if columns else [()] * len(values)

    return struct
