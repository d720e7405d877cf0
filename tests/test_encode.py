"""Scalar rules on values: decimals, times, ranges, display text."""

from __future__ import annotations

import datetime as dt
import decimal
import enum

import pytest

from recfold.errors import EncodeError
from recfold.functions import encode
from recfold.runtime import ManualRecord, half_even_mantissa
from recfold.types import Leaf

D = decimal.Decimal


@pytest.mark.parametrize(
    ("text", "scale", "mantissa"),
    [("1.005", 2, 100), ("1.015", 2, 102), ("1.025", 2, 102), ("-1.005", 2, -100), ("-1.015", 2, -102), ("0.5", 0, 0), ("1.5", 0, 2), ("2.5", 0, 2), ("-2.5", 0, -2), ("2.51", 0, 3), ("7", 3, 7000), ("0", 5, 0), ("1E+3", 1, 10000), ("0.004999", 2, 0), ("99.995", 2, 10000), ("123.456", 3, 123456)],
)
def test_half_even(text, scale, mantissa):
    assert half_even_mantissa(D(text), scale) == mantissa


def test_rescale_fails():
    assert half_even_mantissa(D(1), 39) is None
    assert half_even_mantissa(D("1e38"), 10) is None
    with pytest.raises(EncodeError, match="can't be rescaled"):
        encode.rescaled(38, 10, lambda v, s: None)(D(1))
    with pytest.raises(EncodeError, match="more than 4 digits"):
        encode.rescaled(4, 2, half_even_mantissa)(D("99.995"))
    assert encode.rescaled(38, 10, half_even_mantissa)(D("1234567890123456789012345678.0123456789")) == D("1234567890123456789012345678.0123456789")


@pytest.mark.parametrize(("name", "good", "bad"), [("i8", -128, 128), ("u8", 255, -1), ("u16", 65535, 65536), ("u32", 2**32 - 1, 2**32), ("u64", 2**64 - 1, 2**64), ("i128", -(2**127), 2**127), ("u128", 2**128 - 1, 2**128)])
def test_ranges(name, good, bad):
    assert int(encode.integer(Leaf(name))(good)) == good
    for value in (bad, True, 1.0, "1"):
        with pytest.raises(EncodeError):
            encode.integer(Leaf(name))(value)


def test_non_zero():
    with pytest.raises(EncodeError):
        encode.integer(Leaf("i32", nonzero=True))(0)


def test_datetimes_floor_and_durations_truncate():
    before = dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    assert encode.datetime_in("ms")(before) == dt.datetime(1969, 12, 31, 23, 59, 59, 999_000)
    assert encode.datetime_in("ns")(before) == -1_000
    assert encode.datetime_in("us")(dt.datetime(2020, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2)))) == dt.datetime(2020, 1, 1)
    with pytest.raises(EncodeError):
        encode.datetime_in("ns")(dt.datetime(2300, 1, 1))
    assert encode.duration_in("ms", True)(-1_500_000) == dt.timedelta(milliseconds=-1)
    assert encode.duration_in("ns", True)(-1) == -1
    assert encode.duration_in("us", True)(dt.timedelta(milliseconds=-50)) == dt.timedelta(milliseconds=-50)
    with pytest.raises(EncodeError):
        encode.duration_in("ns", False)(-1)
    assert encode.time_of_day(86_399_999_999_999) == 86_399_999_999_999
    assert encode.time_of_day(dt.time(1, 2, 3, 4)) == 3_723_000_004_000
    with pytest.raises(EncodeError):
        encode.time_of_day(86_400_000_000_000)


@pytest.mark.parametrize(
    ("value", "shown"),
    [(True, "true"), (1.0, "1"), (1.5, "1.5"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (float("inf"), "inf"), (float("nan"), "NaN"), (-0.0, "-0"), (D("1.50"), "1.50"), (7, "7"), (dt.datetime(2020, 1, 2, 3, 4, 5, 120_000), "2020-01-02 03:04:05.120"), (dt.date(2020, 1, 2), "2020-01-02")],
)
def test_display(value, shown):
    assert encode.display(value) == shown


def test_display_failure_is_an_error():
    class Bad:
        def __str__(self):
            raise ValueError("no")

    with pytest.raises(EncodeError):
        encode.display(Bad())


def test_text_takes_hooks_and_enums():
    class Code:
        def as_str(self):
            return "code"

    assert encode.text(Code()) == "code"
    assert encode.text(enum.Enum("E", {"A": "a"}).A) == "a"
    with pytest.raises(EncodeError):
        encode.text(5)


def test_manual_record_is_checked():
    with pytest.raises(EncodeError, match="height"):
        ManualRecord(lambda: [("a", None)], lambda rows: []).rows([1])
    with pytest.raises(EncodeError, match="width"):
        ManualRecord(lambda: [("a", None)], lambda rows: [(1, 2)]).rows([1])
