"""Deterministic stratified samples, whole-group samples and leakage-free splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgate.functions.columns import named, predictors
from flowgate.functions.keys import order_key, vector_key
from flowgate.operators.cuts import Cut, Targets, class_values, find_cuts, segment, totals
from flowgate.operators.verdicts import keep_rows
from flowgate.staging import stage

# Split names and shares.
SPLITS = ("train", "validation", "test")
RATIOS = (0.70, 0.15, 0.15)

SEED = 42
# Copies of one row are emitted in blocks of this many, spread over the cluster.
COPY_BLOCK = 100_000


# ---------------------------------------------------------------- quotas

def class_quotas(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows to draw per class: proportional, at least one, the rounding remainder goes to the largest label."""
    return shared_out(df.groupBy(named(label).alias(label)).agg(F.count(F.lit(1)).alias("rows")), label, n)


def shared_out(counts: DataFrame, label: str, n: int) -> DataFrame:
    """The quotas of classes whose ``rows`` are already counted."""
    everything = Window.partitionBy(F.lit(0))
    share = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("rows") / F.sum("rows").over(everything)).cast("bigint"))
    first = counts.withColumn("quota", share)
    rest = F.lit(n) - F.sum("quota").over(everything)
    last = named(label) == F.max(named(label)).over(everything)
    return first.withColumn("quota", F.when(last, F.col("quota") + rest).otherwise(F.col("quota")).cast("bigint"))


# ---------------------------------------------------------------- rows into segments

def _all_columns_key(df: DataFrame, seed: object) -> Column:
    return F.sha2(F.to_json(F.struct(*[named(c).alias(c) for c in df.columns], F.lit(str(seed)).alias("_seed"))), 256)


def _copies(rows: DataFrame, columns: Sequence[str], shares: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Copies of one row per (cell, key), as many per segment as ``shares`` = (cell, key, segment, number) says, made in parallel blocks."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([s for s in shares if s[3] > 0], "_cell string, _k string, _seg int, _n bigint")
    one = rows.groupBy("_cell", "_k").agg(F.first(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("_row"))
    blocks = one.join(F.broadcast(wanted), ["_cell", "_k"]).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPY_BLOCK)))
    )
    spread = blocks.repartition(spark.sparkContext.defaultParallelism, "_cell", "_k", "_seg", "_block")
    size = F.least(F.lit(COPY_BLOCK).cast("bigint"), F.col("_n") - F.col("_block") * COPY_BLOCK)
    numbered = spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
    return numbered.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(columns)], "_seg")


def _shares(cuts: Mapping[tuple[object, int], Cut], cls: object, key: str, n_cuts: int, rows: float) -> list[tuple[int, int]]:
    """How many of the key's rows fall into each segment."""
    ends = []
    for j in range(n_cuts):
        cut = cuts.get((cls, j))
        if cut is None or cut.key < key:
            ends.append(0)
        else:
            ends.append(rows if cut.key > key else cut.take)
    ends.append(rows)
    return [(j, int(end - (ends[j - 1] if j else 0))) for j, end in enumerate(ends)]


def assign_segments(df: DataFrame, label: str, targets: Targets, key: Column, n_cuts: int, seed: object, whole_groups: bool) -> DataFrame:
    """``df`` with ``_seg``, the number of targets that lie before the row in key order within its class.

    With ``whole_groups`` rows of one key stay together and a segment ends with the key that reaches the
    target. Otherwise targets are met exactly: rows that share the boundary key are ordered by all their
    columns, and if even those are equal, copies are dealt out by number.
    """
    classes = sorted({c for c, _ in targets})
    tagged = df.withColumn("_k", key)
    y, k = named(label), F.col("_k")
    cuts = find_cuts(tagged, targets, label, "_k")
    placed = segment(cuts, y, k, classes, n_cuts)
    open_cuts = {} if whole_groups else {c: cut for c, cut in cuts.items() if cut.straddles}
    columns = [named(c) for c in df.columns]
    if not open_cuts:
        return tagged.select(*columns, placed.alias("_seg"))

    # Only keys with more rows than the boundary leaves room for come here: all of them in one filter, stored, and cut once more
    # as classes of their own, by all their columns.
    cell = F.concat_ws("/", y.cast("string"), k)
    spots = sorted({(cls, cut.key) for (cls, _), cut in open_cuts.items()}, key=str)
    names = dict(zip(spots, _cell_names(df.sparkSession, df.schema[label].dataType, spots), strict=True))
    at_boundary = cell.isin(list(names.values()))
    out = tagged.where(~at_boundary).select(*columns, placed.alias("_seg"))
    here = stage(tagged.where(at_boundary).select(*columns, cell.alias("_cell"), _all_columns_key(df, seed).alias("_k")))
    inner = {}
    for (cls, value), name in names.items():
        size = next(cut.rows for (c, _), cut in cuts.items() if c == cls and cut.key == value)
        for j in range(n_cuts):
            cut = cuts.get((cls, j))
            inner[name, j] = 0.0 if cut is None or cut.key < value else size if cut.key > value else cut.take
    fine = find_cuts(here, inner, "_cell", "_k")
    tied = {(name, cut.key): cut.rows for (name, _), cut in fine.items() if cut.straddles}
    tie = F.concat_ws("/", "_cell", "_k").isin([f"{name}/{key}" for name, key in tied])
    fine_placed = segment(fine, F.col("_cell"), F.col("_k"), list(names.values()), n_cuts)
    out = out.unionByName(here.where(~tie).select(*columns, fine_placed.alias("_seg")))
    shares = [(name, key, seg, n) for (name, key), rows in tied.items() for seg, n in _shares(fine, name, key, n_cuts, rows)]
    return out.unionByName(_copies(here.where(tie), df.columns, shares)) if shares else out


def _cell_names(spark: SparkSession, kind: T.DataType, spots: Sequence[tuple[object, str]]) -> list[str]:
    """Class and key as one text, the class as Spark writes it."""
    schema = T.StructType([T.StructField("cls", kind), T.StructField("key", T.StringType())])
    return [r.name for r in spark.createDataFrame(list(spots), schema).select(F.concat_ws("/", F.col("cls").cast("string"), "key").alias("name")).collect()]


# ---------------------------------------------------------------- samples

def stratified_sample(df: DataFrame, label: str, n: int | None, seed: object = SEED, key: Sequence[str] | None = None, fast: bool = False) -> DataFrame:
    """Exactly ``n`` rows with the class shares of the table; all rows when ``n`` is missing or too large.

    ``key`` names the columns that decide the order, by default all of them.
    """
    if n is None:
        return df
    classes = class_quotas(df, label, n).collect()
    if any(r[label] is None for r in classes):
        raise ValueError(f"column {label} has missing values; map them to a class first")
    if n >= sum(r.rows for r in classes):
        return df
    targets = {(r[label], 0): float(r.quota) for r in classes}
    return sample_to_quota(df, label, targets, seed, key, fast)


def sample_to_quota(df: DataFrame, label: str, targets: Targets, seed: object, key: Sequence[str] | None = None, fast: bool = False) -> DataFrame:
    columns = list(key) if key else df.columns
    out = assign_segments(df, label, targets, order_key(columns, seed, fast), 1, seed, whole_groups=False)
    return out.where(F.col("_seg") == 0).drop("_seg")


def evaluation_subset(df: DataFrame, label: str, limit: int = 20_000, seed: object = 314159, key: Sequence[str] | None = None) -> DataFrame:
    """A fixed subset for robustness runs: ``min(limit, N)`` rows shared out by class share, each rounded."""
    counts = totals(df, label)
    whole = sum(counts.values())
    targets = {(c, 0): float(min(v, round(min(limit, whole) * v / whole))) for c, v in counts.items()}
    return sample_to_quota(df, label, targets, seed, key)


def fixed_sample(df: DataFrame, limit: int = 1024, seed: object = 314159, key: Sequence[str] | None = None) -> DataFrame:
    """The first rows in hash order. A top-k per task and one merge, so nothing is sorted as a whole."""
    columns = list(key) if key else df.columns
    ordered = df.withColumn("_k", order_key(columns, seed)).withColumn("_all", _all_columns_key(df, seed))
    return ordered.orderBy("_k", "_all").limit(limit).drop("_k", "_all")


def shuffled(df: DataFrame, seed: object = SEED, key: Sequence[str] | None = None) -> DataFrame:
    """All rows in a repeatable random order: a range-partitioned sort. Rows with one key are ordered by all their columns."""
    ordered = df.withColumn("_k", order_key(list(key) if key else df.columns, seed)).withColumn("_all", _all_columns_key(df, seed))
    return ordered.orderBy("_k", "_all").drop("_k", "_all")


def pack_groups(df: DataFrame, label: str, group: Sequence[str], n: int, seed: object = SEED, **limits: int) -> DataFrame:
    """Whole groups until each class quota is full: smallest groups first, equal sizes in hash order.

    Sizes form a small table per class. Sizes that fit completely are taken, larger ones than the boundary
    size cannot fit, and among groups of the boundary size a hash cut takes as many as there is room for.
    """
    tagged = df.withColumn("_key", vector_key([*group, label])).withColumn("_order", order_key(group, seed))
    groups = stage(
        tagged.groupBy("_key").agg(
            F.first(named(label)).alias(label), F.first("_order").alias("_order"), F.count(F.lit(1)).alias("_n")
        )
    )
    by_class = groups.groupBy(named(label).alias(label)).agg(F.sum("_n").alias("rows"))
    quota = {r[label]: r.quota for r in shared_out(by_class, label, n).collect()}
    keep = packing_rule(groups, label, quota, "_n", "_order")
    verdicts = groups.withColumn("_keep", keep)
    return keep_rows(tagged, verdicts, "_key", "_keep", "_n", **limits).drop("_key", "_order")


def packing_rule(groups: DataFrame, label: str, quota: Mapping[object, int], size: str, order: str) -> Column:
    """Boolean rule over a group table for the smallest-first packing."""
    sizes = groups.groupBy(named(label).alias("y"), F.col(size).alias("s")).agg(F.count(F.lit(1)).alias("g"))
    running = Window.partitionBy("y").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sizes.withColumn("after", F.sum(F.col("s") * F.col("g")).over(running))
    limit = class_values({c: [str(int(q))] for c, q in quota.items()}, F.col("y"))[0].cast("bigint")
    # The boundary size of each class: the smallest one that does not fit completely.
    edges = (
        filled.where(F.col("after") > limit)
        .groupBy("y")
        .agg(F.min(F.struct("s", "g", "after")).alias("e"))
        .select("y", "e.*")
        .collect()
    )
    edge = {e.y: (e.s, (quota[e.y] - (e.after - e.s * e.g)) // e.s) for e in edges}
    if not edge:
        return F.lit(True)
    y, s, k = named(label), F.col(size), F.col(order)
    sizes_at = class_values({c: [str(n)] for c, (n, _) in edge.items()}, y)[0].cast("bigint")
    cuts = find_cuts(groups.where(s == sizes_at), {(c, 0): float(room) for c, (_, room) in edge.items()}, label, order)
    # One flat map, however many classes there are: the boundary size and the last group of that size which has room.
    facts = class_values({c: [str(n), cuts[c, 0].key if (c, 0) in cuts else None] for c, (n, _) in edge.items()}, y)
    fits = (s < facts[0].cast("bigint")) | ((s == facts[0].cast("bigint")) & F.coalesce(k <= facts[1], F.lit(False)))
    return F.when(facts.isNull(), True).otherwise(fits)


# ---------------------------------------------------------------- splits

def _check(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"the shares of the splits add up to {sum(ratios):g} instead of 1")


def _split_targets(counts: Mapping[object, int], ratios: Sequence[float]) -> Targets:
    return {
        (c, j): round(sum(ratios[: j + 1]) * n, 6) for c, n in counts.items() for j in range(len(ratios) - 1)
    }


def _named_splits(out: DataFrame) -> DataFrame:
    return out.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("_seg") + 1)).drop("_seg")


def split_rows(df: DataFrame, label: str, seed: object = SEED, ratios: Sequence[float] = RATIOS, key: Sequence[str] | None = None) -> DataFrame:
    """Stratified row split with a ``split`` column; each class is cut at its own whole-row quotas."""
    _check(ratios)
    targets = {c: float(-(-t // 1)) for c, t in _split_targets(totals(df, label), ratios).items()}
    order = order_key(list(key) if key else df.columns, seed)
    return _named_splits(assign_segments(df, label, targets, order, len(ratios) - 1, seed, whole_groups=False))


def split_label_groups(df: DataFrame, label: str, group: Sequence[str], seed: object = SEED, ratios: Sequence[float] = RATIOS, fast: bool = False) -> DataFrame:
    """Class-stratified split of whole groups by row count.

    Groups of a class are placed in hash order: train while fewer than the train share of the class's rows
    is placed, then validation, then test. A share is off by at most one group per cut. Groups must carry
    one label each (see ``drop_conflicts``); a group with two labels is placed once per label.
    """
    _check(ratios)
    targets = _split_targets(totals(df, label), ratios)
    order = order_key(group, seed, fast)
    return _named_splits(assign_segments(df, label, targets, order, len(ratios) - 1, seed, whole_groups=True))


def split_groups(df: DataFrame, group: Sequence[str], seed: object = SEED, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Group-disjoint split by the number of groups; labels play no role, no group crosses splits."""
    _check(ratios)
    tagged = df.withColumn("_k", order_key(group, seed))
    # One row per group: copies collapse map-side.
    groups = stage(tagged.select(F.lit(0).alias("_all"), "_k").distinct())
    targets = _split_targets({0: groups.count()}, ratios)
    cuts = find_cuts(groups, targets, "_all", "_k")
    placed = segment(cuts, F.lit(0), F.col("_k"), [0], len(ratios) - 1)
    return _named_splits(tagged.withColumn("_seg", placed).drop("_k"))


def split_metadata(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows and class counts per split."""
    return df.groupBy(named(split), named(label).alias(label)).agg(F.count(F.lit(1)).alias("rows"))


def split_overlap(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """For each pair of splits, the number of distinct feature vectors they share.

    One grouping by vector notes the splits it occurs in as a bit set; no joins.
    """
    member = [F.max((named(split) == s).cast("int")).alias(s) for s in SPLITS]
    seen = df.groupBy(vector_key(features).alias("key")).agg(*member)
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1:]]
    counted = seen.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}") for a, b in pairs])
    rows = [
        F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"{a}_{b}").alias("shared_vectors"))
        for a, b in pairs
    ]
    return counted.select(F.inline(F.array(*rows)))


def freeze_keys(sample: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """Write the keys of a sample once; later runs filter on the stored list (``keep_listed``)."""
    sample.select(*[named(c) for c in key]).distinct().write.mode("ignore").parquet(path)
    return sample.sparkSession.read.parquet(path)
