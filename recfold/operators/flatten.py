"""Nested columns to flat ones, as a single projection.

A field of a struct is one ``getField``; of a list of structs too, which keeps nested column pruning;
below two or more list layers it is a ``transform`` for each further layer. Options emit nothing: null
structs and null elements give nulls in every column below them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RecordError
from ..functions.columns import display_text, encoded
from ..types import Logical


@dataclass(frozen=True)
class FlatColumn:
    """A flat column: its dotted name, type, the fields to its leaf (None: the elements of a list), and what its values must be besides."""

    name: str
    logical: Logical
    path: tuple[str | None, ...]
    rule: str | None = None

    @property
    def leaf(self) -> Logical:
        out = self.logical
        for step in self.path:
            out = out.args[0] if step is None else out
        return out


def flat_columns(root: Any) -> list[FlatColumn]:
    """The columns of an analysed record, depth first in declaration order."""
    out: list[FlatColumn] = []

    def walk(t: Any, name: str, path: tuple, layers: int) -> None:
        if hasattr(t, "of"):
            walk(t.of, name, path, layers)
        elif hasattr(t, "item"):
            walk(t.item, name, (*path, None), layers + 1)
        elif hasattr(t, "fields"):
            for field, inner in t.fields:
                walk(inner, f"{name}.{field}" if name else field, (*path, field), layers)
        else:
            logical = t.logical
            for _ in range(layers):
                logical = Logical("List", (logical,))
            out.append(FlatColumn(name, logical, path, t.rule))

    walk(root, "", (), 0)
    seen: set[str] = set()
    for c in out:
        if c.name in seen:
            raise RecordError("names", f"two fields give the column {c.name}")
        seen.add(c.name)
    return out


def under(c: Column, layers: int, apply: Callable[[Column], Column], field: bool = False) -> Column:
    """``apply`` to what stands below list layers; taking a field needs no lambda for the last of them."""
    if layers == 0 or field and layers == 1:
        return apply(c)
    return F.transform(c, lambda x: under(x, layers - 1, apply, field))


def _expression(column: FlatColumn, schema: T.StructType, carried: bool) -> Column:
    first, *rest = column.path
    c, layers, source = F.col(f"`{first}`"), 0, schema[first].dataType
    for step in rest:
        if step is None:
            binary = isinstance(source, T.BinaryType)
            layers, source = layers + 1, T.ShortType() if binary else source.elementType
        else:
            c = under(c, layers, lambda x, s=step: x.getField(s), field=True)
            source = source[step].dataType
    if not carried:
        leaf = column.leaf
        if leaf.kind == "String" and not isinstance(source, T.StringType):
            c = under(c, layers, lambda x: display_text(x, source))
        else:
            probe = encoded(F.lit(None), leaf, source, column.rule)  # a leaf that is carried as it is needs no lambda
            if str(probe) != str(F.lit(None)):
                c = under(c, layers, lambda x: encoded(x, leaf, source, column.rule))
    return c.alias(column.name, metadata={"logical": str(column.logical)})


def flatten(df: DataFrame, columns: list[FlatColumn], carried: bool = False) -> DataFrame:
    """The flat columns of ``df``. ``carried``: leaves are already encoded."""
    return df.select(*(_expression(c, df.schema, carried) for c in columns))
