"""Exact duplicates and label conflicts.

Every figure comes from one grouped table: per feature vector the number of rows of each label. The
label counts are aggregates, not a second grouping level, so the raw rows are reduced map-side and
cross the network once, however many copies a vector has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgate.functions.columns import named, predictors
from flowgate.functions.keys import vector_key
from flowgate.functions.numbers import share

N, BENIGN, ATTACK, UNLABELLED, LABELS = "n", "n_benign", "n_attack", "n_unlabelled", "label_count"


def vector_groups(df: DataFrame, features: Sequence[str], label: str, exact_key: bool = False) -> DataFrame:
    """One row per feature vector: ``key`` (or the features), row counts by label, number of labels.

    ``label`` holds 0, 1 or NULL; NULL counts as a label of its own. With ``exact_key`` the grouping is on
    the columns themselves, at the price of shuffling them.
    """
    y = named(label)
    keys = [named(f) for f in features] if exact_key else [vector_key(features).alias("key")]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(N),
        F.count_if(y == 0).alias(BENIGN),
        F.count_if(y == 1).alias(ATTACK),
        F.count_if(y.isNull()).alias(UNLABELLED),
    )
    kinds = sum(((F.col(c) > 0).cast("int") for c in (BENIGN, ATTACK, UNLABELLED)), F.lit(0))
    return grouped.withColumn(LABELS, kinds)


def duplicate_audit(groups: DataFrame) -> DataFrame:
    """The duplicate and conflict figures of a table, from its vector groups, as one row."""
    n, k = F.col(N), F.col(LABELS)
    repeated, conflict = n > 1, k > 1

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")

    out = groups.agg(
        total(n).alias("rows_total"),
        F.count(F.lit(1)).alias("unique_feature_vectors"),
        F.count_if(repeated).alias("duplicate_groups"),
        total(F.when(repeated, n)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.avg(F.when(repeated, n)), F.lit(0.0)).alias("mean_duplicate_group_size"),
        F.coalesce(F.max(F.when(repeated, n)), F.lit(0)).cast("bigint").alias("max_duplicate_group_size"),
        F.count_if(conflict).alias("cross_label_duplicate_groups"),
        total(F.when(conflict, n)).alias("cross_label_duplicate_rows"),
        total(F.when(repeated & ~conflict, n - 1)).alias("within_label_duplicate_rows"),
    )
    duplicates = F.col("rows_total") - F.col("unique_feature_vectors")
    return out.select(
        "*",
        duplicates.alias("duplicate_rows"),
        (share(duplicates, F.col("rows_total")) * 100).alias("duplicate_rows_pct"),
        (share(F.col("cross_label_duplicate_rows"), F.col("rows_total")) * 100).alias("cross_label_duplicate_pct"),
    )


def label_summary(groups: DataFrame) -> DataFrame:
    """Per label: original rows, label-consistent vectors, rows in conflicting vectors."""
    k = F.col(LABELS)
    slots = [("0", BENIGN), ("1", ATTACK), (None, UNLABELLED)]
    totals = groups.agg(
        *[
            F.struct(
                F.lit(label).cast("int").alias("binary_label"),
                F.coalesce(F.sum(c), F.lit(0)).alias("original_rows"),
                F.count_if((F.col(c) > 0) & (k == 1)).alias("deduplicated_rows"),
                F.coalesce(F.sum(F.when(k > 1, F.col(c))), F.lit(0)).alias("conflicting_rows"),
            ).alias(c)
            for label, c in slots
        ]
    )
    return totals.select(F.inline(F.array(*[F.col(c) for _, c in slots]))).where(F.col("original_rows") > 0)


def vector_labels(groups: DataFrame) -> DataFrame:
    """The groups with the sorted list of labels each vector occurs with; a missing label comes last."""
    seen = F.array(
        F.when(F.col(BENIGN) > 0, F.lit(0)), F.when(F.col(ATTACK) > 0, F.lit(1)),
    )
    labels = F.array_compact(seen)
    return groups.withColumn(
        "labels", F.when(F.col(UNLABELLED) > 0, F.array_append(labels, F.lit(None).cast("int"))).otherwise(labels)
    )


def exact_duplicates(df: DataFrame, provenance: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each set of equal rows, provenance columns left out of the comparison."""
    key = vector_key(predictors(df, provenance)).alias("key")
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias(N))
    out = counted.agg(
        F.coalesce(F.sum(N), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col(N) - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return out.withColumn("duplicate_pct", share(F.col("duplicate_rows"), F.col("rows")) * 100)


def duplicates_by(df: DataFrame, by: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Duplicate rows inside each source file or class; values without duplicates are absent.

    ``by`` belongs to the row key, ``excluded`` columns do not.
    """
    key = vector_key(predictors(df, [by, *excluded])).alias("key")
    counted = df.groupBy(named(by), key).agg(F.count(F.lit(1)).alias(N)).where(F.col(N) > 1)
    return counted.groupBy(named(by)).agg(F.sum(F.col(N) - 1).alias("duplicate_rows"))


def deduplicate(df: DataFrame, features: Sequence[str], label: str, identity: Sequence[str] | None = None) -> DataFrame:
    """One row per label-consistent vector; vectors that carry two labels are dropped.

    ``identity`` are the columns that make up a vector, by default the features. When it covers more than
    the features the smallest feature row stands for the vector, so the result is repeatable.
    """
    y = named(label)
    values = F.struct(*[named(f).alias(f) for f in features])
    if identity is None or list(identity) == list(features):
        grouped = df.groupBy(*[named(f) for f in features])
        pick: list[Column] = []
        columns = [named(f) for f in features]
    else:
        grouped = df.groupBy(vector_key(identity).alias("_key"))
        pick = [F.min(values).alias("_row")]
        columns = [F.col("_row")[f].alias(f) for f in features]
    # min = max instead of a distinct count: it combines map-side into two integers per vector.
    one = grouped.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.count(F.lit(1)).alias("copies"), *pick)
    return one.where(F.col("_lo") == F.col("_hi")).select(*columns, F.col("_lo").alias(label), "copies")
