"""Columns that should be numeric but are stored as text: what does not parse, and what it would cost to drop it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgate.functions.columns import long_values, named
from flowgate.functions.numbers import any_not_a_number, ipv4_shaped, not_a_number, number, share

# How many tokens are listed, and the limits a cleaning must respect.
TOP_TOKENS = 20
MAX_REMOVED_SHARE = 0.01
MAX_LABEL_SHIFT_PP = 0.5
MAX_CLASS_LOSS_PCT = 10.0


def numeric_checks(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Rows, unreadable values, minimum and maximum of each declared-numeric column, in one scan."""
    aggregates, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(numeric):
        c = named(f)
        aggregates += [
            F.count_if(not_a_number(c)).alias(f"b{i}"), F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(f).alias("feature"), F.col("n").alias("rows"), F.col(f"b{i}").alias("nonnumeric"),
                F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def type_audit(df: DataFrame, features: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Per feature: expected type, readable and unreadable values, their share, and how many look like IPv4.

    The unreadable figures of categorical features are missing, since any text is fine there.
    """
    wanted = set(numeric)
    aggregates, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(features):
        c = named(f)
        aggregates += [
            F.count(number(c)).alias(f"g{i}"), F.count_if(not_a_number(c)).alias(f"b{i}"),
            F.count_if(not_a_number(c) & ipv4_shaped(c.cast("string"))).alias(f"ip{i}"),
        ]

        def only_numeric(x, kind):
            return (x if f in wanted else F.lit(None)).cast(kind)

        rows.append(
            F.struct(
                F.lit(f).alias("feature"), F.lit("numeric" if f in wanted else "categorical").alias("expected_type"),
                only_numeric(F.col(f"g{i}"), "bigint").alias("actual_numeric_count"),
                only_numeric(F.col(f"b{i}"), "bigint").alias("actual_non_numeric_count"),
                only_numeric(share(F.col(f"b{i}"), F.col("n")) * 100, "double").alias("non_numeric_pct"),
                F.col(f"ip{i}").alias("ip_like_count"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def top_bad_tokens(df: DataFrame, features: Sequence[str], limit: int = TOP_TOKENS) -> DataFrame:
    """The most frequent unreadable tokens of each feature; ties by token."""
    bad = long_values(df, features).where(not_a_number(F.col("value")))
    counted = bad.groupBy("feature", F.col("value").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    # A literal limit on row_number keeps only that many rows per feature already before the shuffle.
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("token"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def clean_rows(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Rows whose numeric features all parse; a missing value is not an unreadable one."""
    return df.where(~any_not_a_number(numeric))


def cleaning_report(df: DataFrame, numeric: Sequence[str], label: str, kind: str) -> DataFrame:
    """What dropping unreadable rows would cost, overall, by label and by class, against three limits.

    ``label`` is 0/1. Grouping by (class, label) is combined map-side, everything after it is a handful of rows.
    """
    cells = df.groupBy(named(kind).alias("kind"), named(label).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_not_a_number(numeric)).alias("bad")
    )

    by_kind = cells.groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        *[F.sum(F.when(F.col("y") == c, F.col(v))).alias(f"{v}{c}") for c in (0, 1) for v in ("n", "bad")],
    )
    out = by_kind.agg(
        F.sum("n").alias("rows"),
        F.sum("bad").alias("rows_removed"),
        F.abs(share(F.sum("bad0"), F.sum("n0")) * 100 - share(F.sum("bad1"), F.sum("n1")) * 100).alias("binary_shift_pp"),
        F.max(share(F.col("bad"), F.col("n")) * 100).alias("max_class_removed_pct"),
    )
    removed = share(F.col("rows_removed"), F.col("rows"))
    return out.select(
        "rows", "rows_removed", (F.col("rows") - F.col("rows_removed")).alias("clean_rows"),
        (removed * 100).alias("removed_pct"), "binary_shift_pp", "max_class_removed_pct",
        (removed <= MAX_REMOVED_SHARE).alias("global_pass"),
        (F.col("binary_shift_pp") < MAX_LABEL_SHIFT_PP).alias("binary_balance_pass"),
        (F.col("max_class_removed_pct") < MAX_CLASS_LOSS_PCT).alias("class_pass"),
    )


def feature_removal(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """For each feature: its unreadable values, and the bad rows that remain if that feature is given up.

    A row stays bad without feature f unless f is its only bad feature, so one scan that counts, per
    feature, the rows it alone spoils answers all candidates at once. ``dominant`` marks the greedy choice:
    the smallest residual, ties by name.
    """
    flags = [not_a_number(named(f)).cast("int") for f in numeric]
    bad = sum(flags[1:], flags[0])
    tagged = df.select(*[x.alias(f"b{i}") for i, x in enumerate(flags)], bad.alias("bad"))
    one = tagged.agg(
        F.count_if(F.col("bad") > 0).alias("total"),
        *[F.sum(f"b{i}").alias(f"n{i}") for i in range(len(numeric))],
        *[F.count_if((F.col(f"b{i}") == 1) & (F.col("bad") == 1)).alias(f"s{i}") for i in range(len(numeric))],
    )
    candidates = [
        F.struct((F.col("total") - F.col(f"s{i}")).alias("residual_rows"), F.lit(f).alias("feature"), F.col(f"n{i}").alias("nonnumeric"))
        for i, f in enumerate(numeric)
    ]
    listed = one.select("total", F.array_sort(F.array(*candidates)).alias("c"))
    return listed.select("total", F.col("c")[0]["feature"].alias("_best"), F.explode("c").alias("r")).select(
        "r.feature", F.coalesce("r.nonnumeric", F.lit(0)).alias("nonnumeric"), F.col("total").alias("bad_rows"), "r.residual_rows",
        ((F.col("r.feature") == F.col("_best")) & (F.col("total") > 0)).alias("dominant"),
    )
