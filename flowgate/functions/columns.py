"""Small helpers to address columns by name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """A column by its exact name; names may hold dots and spaces (``tcp.len``, ``Tot sum``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def predictors(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    """Column names of ``df`` without target, type and provenance columns; order is kept."""
    out = set(excluded)
    return [c for c in df.columns if c not in out]


def numeric_columns(df: DataFrame, excluded: Iterable[str] = ()) -> list[str]:
    out = set(excluded)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in out]


def features_and_target(df: DataFrame, target: str, excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """X without target and extras, and y alone."""
    drop = {target, *excluded}
    return df.select(*[named(c) for c in df.columns if c not in drop]), df.select(named(target))


def forbidden_features(features: Iterable[str], forbidden: Iterable[str]) -> list[str]:
    """Contract guard: names that must never be model inputs but are."""
    return sorted(set(features) & set(forbidden))


def long_values(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), cast: str = "string") -> DataFrame:
    """One row per (row, feature): ``keep`` columns, ``feature``, ``value`` cast to one type.

    An explode of an inline array, so all features are read in a single scan. ``-0.0`` becomes ``0.0``
    so that its text equals that of ``0.0``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def value(name: str) -> Column:
        c = named(name)
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)
        return c.try_cast(cast) if cast != "string" else c.cast(cast)

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), value(f).alias("value")) for f in features])
    return df.select(*[named(k) for k in keep], F.explode(cells).alias("cell")).select(
        *[named(k) for k in keep], "cell.feature", "cell.value"
    )


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on key columns in which a missing key equals a missing key, as it does in a grouping."""
    renamed = right.select(*[named(c).alias(f"_r_{c}") if c in set(keys) else named(c) for c in right.columns])
    on = [named(k).eqNullSafe(named(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
