"""Numeric tests that stay safe under ANSI mode and in the presence of NaN and infinities."""

from __future__ import annotations

from functools import reduce
from operator import or_

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgate.functions.columns import named

# Fixed value: shape of an IPv4 address in text.
IPV4_SHAPE = r"^(?:\d{1,3}\.){3}\d{1,3}\z"

INFINITY = float("inf")


def number(c: Column) -> Column:
    """Text or number as double; text that is not a number becomes missing."""
    return c.try_cast("double")


def not_a_number(c: Column) -> Column:
    """True where a value is present but cannot be read as a number."""
    return c.isNotNull() & number(c).isNull()


def any_not_a_number(features: Sequence[str]) -> Column:
    """True where at least one of the columns holds unreadable text."""
    return reduce(or_, [not_a_number(named(f)) for f in features], F.lit(False))


def finite(c: Column) -> Column:
    """The value where it is finite; NaN and both infinities become missing."""
    x = number(c)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INFINITY)), x)


def measured(c: Column) -> Column:
    """The value as double; NaN, which would be the largest of all, becomes missing."""
    return F.nanvl(number(c), F.lit(None).cast("double"))


def is_positive_infinity(c: Column) -> Column:
    return number(c) == F.lit(INFINITY)


def is_negative_infinity(c: Column) -> Column:
    return number(c) == F.lit(-INFINITY)


def ipv4_shaped(c: Column) -> Column:
    return c.rlike(IPV4_SHAPE)


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
