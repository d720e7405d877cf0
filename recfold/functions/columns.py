"""The leaf rules as column expressions, for values that are already in a DataFrame.

Times are reckoned in microseconds since 1970 UTC, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import INTEGERS, Logical, carrier

MILLION = 1_000_000
DAY_NANOS = 86_400_000_000_000
_RANGES = {kind: (least, most) for kind, least, most, _ in INTEGERS.values()}
_HOLDS = {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31, T.LongType: 1 << 63}


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def interval_micros(c: Column) -> Column:
    """The microseconds of a day-time interval."""
    whole = c.cast(T.DayTimeIntervalType())  # some intervals have no days, say
    part = lambda name: F.date_part(F.lit(name), whole)
    minutes = (part("DAY").cast("long") * 24 + part("HOUR").cast("long")) * 60 + part("MINUTE").cast("long")
    return minutes * (60 * MILLION) + (part("SECOND") * MILLION).cast("long")


def micros_interval(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def timestamp_micros(c: Column, source: T.DataType) -> Column:
    """The microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(c) if isinstance(source, T.TimestampType) else interval_micros(c - _epoch())


def time_nanos(c: Column) -> Column:
    """The nanoseconds of the day of a time."""
    seconds = F.date_part(F.lit("SECOND"), c)
    return (F.hour(c).cast("long") * 3_600 + F.minute(c).cast("long") * 60) * 1_000_000_000 + (seconds * 1_000_000_000).cast("long")


def _thirds(text: Column) -> Column:
    """Text of a time with none, three or six digits of a second's fraction."""
    fraction = F.regexp_extract(text, r"\.([0-9]+)$", 1)
    digits = F.ceil(F.length(fraction) / 3).cast("int") * 3
    return F.when(F.length(fraction) == 0, text).otherwise(F.concat(F.regexp_replace(text, r"\.[0-9]+$", "."), F.rpad(fraction, digits, "0")))


def display_text(c: Column, source: T.DataType) -> Column:
    """Display text of a column. Floats lose a trailing ``.0`` and any exponent; instants are shown in UTC."""
    if isinstance(source, (T.FloatType, T.DoubleType)):
        plain = F.regexp_replace(c.cast("string"), r"\.0$", "")
        mantissa = F.regexp_replace(F.regexp_extract(c.cast("string"), r"^(-?[0-9.]+)E", 1), r"^(-?[0-9]+)\.?", "$1")
        exponent = F.regexp_extract(c.cast("string"), r"E(-?[0-9]+)$", 1).cast("int")
        sign = F.when(F.startswith(mantissa, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        digits = F.regexp_replace(F.regexp_replace(mantissa, "^-", ""), "(?<=.)0$", "")
        large = F.when(exponent + 1 >= F.length(digits), F.rpad(digits, exponent + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        spread = F.concat(sign, F.when(exponent >= 0, large).otherwise(small))
        named = F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
        return F.when(c.isNull(), F.lit(None)).otherwise(named.when(F.contains(c.cast("string"), F.lit("E")), spread).otherwise(plain))
    if isinstance(source, T.TimestampType):
        return F.concat(_thirds((_epoch() + micros_interval(F.unix_micros(c))).cast("string")), F.lit(" UTC"))
    if isinstance(source, (T.TimestampNTZType, T.TimeType)):
        return _thirds(c.cast("string"))
    if isinstance(source, T.DayTimeIntervalType):
        micros = interval_micros(c)
        rest = F.rtrim(F.lpad((F.abs(micros) % MILLION).cast("string"), 6, "0"), F.lit("0"))
        whole = F.concat(F.when(micros < 0, F.lit("-PT")).otherwise(F.lit("PT")), ((F.abs(micros) - F.abs(micros) % MILLION) / MILLION).cast("long").cast("string"), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("S"))
        return F.when(micros == 0, F.lit("P0D")).otherwise(whole)
    return c.cast("string")


def _checked(c: Column, bad: Column, what: str, value: Column) -> Column:
    """``value``, or an error where ``bad`` holds for ``c``."""
    return F.when(bad, F.raise_error(F.concat(c.cast("string"), F.lit(f" {what}")))).otherwise(value)


def _integer(c: Column, logical: Logical, source: T.DataType, rule: str | None) -> Column:
    least, most = _RANGES[logical.kind]
    holds = _HOLDS.get(type(source))
    bad = F.lit(False)
    if holds is None and isinstance(source, (T.DecimalType, T.FloatType, T.DoubleType)):
        bad = (c < F.lit(Decimal(least)).cast("decimal(38,0)")) | (c > F.lit(Decimal(most)).cast("decimal(38,0)")) if most < 10**37 else c < 0 if least == 0 else bad
    elif holds is not None and (least > -holds or most < holds - 1):
        bad = (c < max(least, -holds)) | (c > min(most, holds - 1))
    if rule == "nonzero" and not isinstance(source, T.StringType):
        bad = bad | (c == 0)
    target = carrier(logical)
    value = c if source == target else c.cast(target)
    return value if str(bad) == str(F.lit(False)) else _checked(c, bad, f"is out of range for {'a non-zero ' if rule == 'nonzero' else ''}{logical.kind}", value)


def _duration(c: Column, logical: Logical, source: T.DataType, rule: str | None) -> Column:
    unit = logical.args[0]
    if isinstance(source, T.DayTimeIntervalType):
        micros = interval_micros(c)
        value = micros * 1_000 if unit == "ns" else c.cast(carrier(logical)) if unit == "us" else micros_interval(micros - micros % 1_000)
    else:  # whole nanoseconds
        micros, micros_ms = ((c - c % n) / 1_000 for n in (1_000, 1_000_000))
        value = c.cast("long") if unit == "ns" else micros_interval((micros if unit == "us" else micros_ms).cast("long"))
        micros = c
    return _checked(c, micros < 0, "is negative", value) if rule == "unsigned" else value


def encoded(c: Column, logical: Logical, source: T.DataType, rule: str | None = None) -> Column:
    """A leaf value as what carries its logical type; the source type is that of the column. Values that the type can't hold are errors."""
    target = carrier(logical)
    if logical.kind == "Decimal":
        if isinstance(source, T.DecimalType) and source.scale <= target.scale:
            return c.cast(target)
        return F.bround(c, target.scale).cast(target)
    if logical.kind in _RANGES:
        return _integer(c, logical, source, rule)
    if logical.kind == "Datetime" and isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        if logical.args[0] == "ns":
            return timestamp_micros(c, source) * 1_000
        if logical.args[0] == "us" and isinstance(source, T.TimestampNTZType):
            return c
        micros = timestamp_micros(c, source)
        return _epoch() + micros_interval(micros - F.pmod(micros, F.lit(1_000)) if logical.args[0] == "ms" else micros)
    if logical.kind == "Duration":
        return _duration(c, logical, source, rule)
    if logical.kind == "Time":
        return time_nanos(c) if isinstance(source, T.TimeType) else _checked(c, (c < 0) | (c >= DAY_NANOS), "is no nanosecond of a day", c.cast("long"))
    if logical.kind == "Binary" and isinstance(source, T.ArrayType):
        bytes_ = F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
        bad = F.exists(c, lambda x: x.isNull() | (x < 0) | (x > 255))
        return F.when(bad, F.raise_error(F.lit("a null or a number that is no byte in binary"))).otherwise(bytes_)
    return c if source == target else c.cast(target)
