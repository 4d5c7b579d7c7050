"""Row fingerprints and deterministic order keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgate.functions.columns import named

ORDER_DIGITS = 32
UNIFORM_DIGITS = 7


def _marked(columns: Sequence[str]) -> list[Column]:
    """Each column followed by its null mark, so that ('a', NULL) and (NULL, 'a') hash differently."""
    return [part for c in columns for part in (named(c), named(c).isNull())]


def fingerprint(columns: Sequence[str]) -> Column:
    """64-bit fingerprint of a feature vector: the identifier stored in model tables."""
    return F.xxhash64(*_marked(columns))


def vector_key(columns: Sequence[str]) -> Column:
    """128-bit key of a feature vector, used to group and join.

    Two chained 64-bit hashes with different starts. Among 10^12 vectors a collision has a probability
    of about 10^-15, where a single 64-bit hash would merge some 27,000 pairs.
    """
    parts = _marked(columns)
    return F.struct(F.xxhash64(*parts).alias("hi"), F.xxhash64(F.lit(7), *parts).alias("lo"))


def order_key(columns: Sequence[str], seed: object, fast: bool = False) -> Column:
    """A repeatable pseudo-random order: 32 hex digits that depend on the columns and the seed only.

    The default is an md5 over the text form, which any SQL engine reproduces; equal keys mean equal values, as a
    grouping sees them. ``fast`` takes two 64-bit hashes instead, several times cheaper per row.
    """
    if fast:
        parts = [F.lit(str(seed)), *_marked(columns)]
        halves = [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)]
        return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))
    return F.md5(F.concat_ws("|", *[_text(c) for c in columns], F.lit(str(seed))).cast("binary"))


def _text(column: str) -> Column:
    """A value as text that differs wherever a grouping tells values apart, and only there.

    Backslashes and separators inside a value are escaped and a missing value has a mark of its own, so neighbouring
    columns cannot be confused. Both zeros are one value.
    """
    c = named(column)
    plain = c.cast("string")
    plain = F.when(F.typeof(c).isin("double", "float") & (plain == "-0.0"), "0.0").otherwise(plain)
    escaped = F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(escaped, F.lit("\\N"))


def uniform(key: Column, slot: int = 0) -> Column:
    """A number in [0, 1) from seven hex digits of an order key; each of its four slots gives another one."""
    digits = F.substring(key, 1 + UNIFORM_DIGITS * slot, UNIFORM_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**UNIFORM_DIGITS))
