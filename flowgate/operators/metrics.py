"""Exact binary classification metrics."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgate.functions.columns import join_by, named
from flowgate.functions.numbers import share
from flowgate.staging import stage

# Decision threshold, alarm threshold, metric names of the reports.
THRESHOLD = 0.5
ALARM = 0.995
ALARM_METRICS = ("accuracy", "f1", "roc_auc", "attack_recall")
METRICS = ("accuracy", "precision", "attack_recall", "specificity", "f1", "roc_auc", "pr_auc", "mcc")

ROWS_PER_CHUNK = 2_000_000  # rows that a task collapses at once, some 200 MB
ROWS_PER_RANGE = 1_000_000  # scores of a group that one task sorts, some 100 MB
ROWS_PER_POINT = 10_000  # scores of a chunk for each one that the bounds of ranges are found from
CUT = ["_part", "_p", "_q", "value", "pos", "neg"]

# Tasks carry the helpers of this module with them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counts(y: Column, pred: Column) -> list[Column]:
    """The four cells of the confusion matrix as aggregates."""
    return [
        F.count_if((y == 1) & (pred == 1)).alias("tp"), F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"), F.count_if((y == 1) & (pred == 0)).alias("fn"),
    ]


def rates(prefix: str = "") -> dict[str, Column]:
    """Rates over the columns tp, tn, fp, fn (with a prefix); 0 wherever a denominator is 0."""
    tp, tn, fp, fn = (F.col(prefix + c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    # Doubles throughout: the product of four counts would overflow a bigint.
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "accuracy": share(tp + tn, tp + tn + fp + fn),
        "precision": share(tp, tp + fp),
        "attack_recall": share(tp, tp + fn),
        "f1": share(tp * 2, tp * 2 + fp + fn),
        "specificity": share(tn, tn + fp),
        "false_positive_rate": share(fp, fp + tn),
        "false_negative_rate": share(fn, fn + tp),
        "mcc": share(tp * tn - fp * fn, F.sqrt(product)),
    }


def predicted(score: Column, threshold: float) -> Column:
    """1 from the threshold on. Spark orders NaN above every number, so it is tested for by itself."""
    return ((score >= F.lit(threshold)) & ~F.isnan(score)).cast("int")


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates per group, in one aggregate."""
    out = df.groupBy(*[named(b) for b in by]).agg(*counts(named(y), named(pred)))
    return out.select("*", *[c.alias(name) for name, c in rates().items()])


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """The 2 x 2 matrix, always both rows: actual class, rows predicted 0, rows predicted 1."""
    cells = df.agg(*counts(named(y), named(pred)))
    row = lambda actual, zero, one: F.struct(
        F.lit(actual).alias("actual"), F.col(zero).alias("predicted_0"), F.col(one).alias("predicted_1")
    )
    return cells.select(F.inline(F.array(row(0, "tn", "fp"), row(1, "fn", "tp"))))


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest one needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _starts(values: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Where another value (or group) starts in sorted rows; NaN equals NaN."""
    new = (values[1:] != values[:-1]) & ~(np.isnan(values[1:]) & np.isnan(values[:-1]))
    if group is not None:
        new |= group[1:] != group[:-1]
    return np.flatnonzero(np.append(True, new)) if len(values) else np.zeros(0, dtype=np.int64)


def _chunked(batches, counted, rows):
    """For each ``rows`` rows of a task and each group in them one row: the group's different scores in order and their counts.

    Rows that are not ``counted`` count once, for the class in the lowest two bits of their group: 0, 1, or 2 for none.
    """
    held: list[tuple] = []
    size = 0

    def chunk():
        group, value, pos, neg = (np.concatenate(x) for x in zip(*held, strict=True))
        encoded = pa.array(group).dictionary_encode()
        names = encoded.dictionary
        # few groups have short numbers, which sort fastest
        group = encoded.indices.to_numpy().astype(np.min_scalar_type(len(names)))
        scored = (pos > 0) | (neg > 0)
        group, value, pos, neg = group[scored], value[scored], pos[scored], neg[scored]
        order = np.argsort(value)
        order = order[np.argsort(group[order], kind="stable")]
        group, value = group[order], value[order]
        starts = _starts(value, group)
        if len(starts):
            pos, neg = np.add.reduceat(pos[order], starts), np.add.reduceat(neg[order], starts)
        group, value = group[starts], value[starts]
        ends = np.searchsorted(group, np.arange(len(names) + 1))
        own = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        packed = [pa.array([f(x[at]) for at in own], pa.binary()) for x, f in ((value, np.ndarray.tobytes), (pos, _packed), (neg, _packed))]
        return pa.RecordBatch.from_arrays([names, *packed], names=["_group", "value", "pos", "neg"])

    for batch in batches:
        group, value = batch.column("_group").to_numpy(), batch.column("value").to_numpy(zero_copy_only=False)
        if counted:
            pos, neg = (batch.column(n).to_numpy().astype(np.int64) for n in ("pos", "neg"))
        else:
            pos, neg = ((group & 3 == y).astype(np.int64) for y in (1, 0))
        held.append((group & ~3, value, pos, neg))
        size += batch.num_rows
        if size >= rows:
            yield chunk()
            held.clear()
            size = 0
    if size:
        yield chunk()


def _points(batches, by):
    """The points as numbers."""
    for batch in batches:
        points = [np.frombuffer(b"".join(p), dtype=np.float64) for p in batch.column("_points").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.select(by).columns, batch.column("_n"), pa.array(points, pa.list_(pa.float64()))], names=[*by, "_n", "_points"])


def _cut(batches, by, scores):
    """The chunks cut at their group's bounds, (by, range, rows of either class); with ``scores`` their scores and counts too."""
    for batch in batches:
        place, out = [], []
        for i, (bounds, *data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_bounds", "value", "pos", "neg")), strict=True)):
            value = np.frombuffer(data[0], dtype=np.float64)
            n = len(value)
            pos, neg = (_unpacked(x, n) for x in data[1:])
            ends = [0, *np.searchsorted(value, np.array(bounds, dtype=np.float64), side="right").tolist(), n]
            for part in range(len(ends) - 1):
                at = slice(ends[part], ends[part + 1])
                # a group without any score has a row too
                if at.stop > at.start or (not n and not part):
                    place.append(i)
                    p, q = pos[at], neg[at]
                    out.append((part, int(p.sum()), int(q.sum()), *((value[at].tobytes(), _packed(p), _packed(q)) if scores else ())))
        kinds = [pa.int64()] * 3 + [pa.binary()] * 3 * scores
        cells = [pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.select(by).take(pa.array(place, pa.int64())).columns, *cells], names=[*by, *CUT[: len(kinds)]])


def _range_sums(table: pa.Table, by) -> pa.Table:
    """What the scores of one range of a group add to both areas."""
    values = [np.frombuffer(v, dtype=np.float64) for v in table["value"].to_pylist()]
    counted = [np.concatenate([_unpacked(c, len(v)) for c, v in zip(table[n].to_pylist(), values, strict=True)]) for n in ("pos", "neg")]
    value = np.concatenate(values)
    order = np.argsort(value, kind="stable")
    starts = _starts(value[order])
    pos, neg = (np.add.reduceat(c[order], starts) if len(starts) else c for c in counted)
    all_p, all_n, p_below, n_below = (table[n][0].as_py() for n in ("P", "N", "p_below", "n_below"))
    p_run, n_run = np.cumsum(pos), np.cumsum(neg)
    # Rows at or above a score, the positive predictions at this threshold.
    tp, fp = (all_p - p_below - p_run + pos).astype(np.float64), (all_n - n_below - n_run + neg).astype(np.float64)
    wins = float((pos * ((n_below + n_run - neg) + neg / 2)).sum())
    precision = float((pos * np.divide(tp, tp + fp, out=np.zeros(len(tp)), where=tp + fp > 0)).sum())
    return pa.Table.from_arrays([*table.select(by).slice(0, 1).combine_chunks().columns, *[pa.array([x]) for x in (wins, precision)], *[pa.array([x], pa.int64()) for x in (all_p, all_n)]], names=[*by, "_wins", "_precision", "_p", "_n"])


def ranking_areas(rows: DataFrame, by: Sequence[str], one_class: float | None = None, parts: int | None = None) -> DataFrame:
    """ROC AUC and average precision per group from rows (by…, value, y), or counted ones (by…, value, pos, neg); a score may come in any number of them.

    AUC counts, for each positive, the negatives below it and half of those with the same score. Average
    precision adds the precision at each distinct score, weighted by the gain in recall. Both need running
    counts over the sorted scores. Each task packs its scores, sorted and collapsed, into one binary a group for every ``ROWS_PER_CHUNK`` rows; these chunks are
    stored, cut into ranges of the group at bounds from some of its scores, and only then dealt out, so a score takes some ten bytes and no row of its own. Totals of
    the ranges below are known before, so each range gives its sums at once. A task holds one chunk, or one range of some ``ROWS_PER_RANGE`` scores, at a time.
    """
    by, counted = list(by), "pos" in rows.columns
    named_by, value = [named(b) for b in by], F.col("value").cast("double")
    # The two lowest bits are free for the class. A missing score has none; it is not filtered out, because a filter on a computed score would make
    # the optimizer compute the score once more below it.
    group = F.xxhash64(F.lit(0), *named_by, *[c.isNull() for c in named_by]).bitwiseAND(F.lit(-4))
    if counted:
        cells = [group.alias("_group"), value.alias("value"), *[F.coalesce(F.when(value.isNotNull(), F.col(c)), F.lit(0)).cast("bigint").alias(c) for c in ("pos", "neg")]]
    else:
        y = F.col("y")
        label = F.when(value.isNull(), 2).when(y == 1, 1).when(y == 0, 0).otherwise(2)
        cells = [group.bitwiseOR(label.cast("bigint")).alias("_group"), value.alias("value")]
    packed = "value binary, pos binary, neg binary"
    chunked = rows.select(*cells).mapInArrow(partial(_chunked, counted=counted, rows=ROWS_PER_CHUNK), f"_group long, {packed}")
    groups = rows.select(*named_by, group.alias("_group")).distinct()
    stored = stage(chunked.join(F.broadcast(groups), "_group").select(*named_by, "value", "pos", "neg"))

    # From here on groups have plain names, and one even where none are asked for.
    keys = [f"_k{i}" for i in range(max(len(by), 1))]
    chunks = stored.select(*[c.alias(k) for c, k in zip(named_by or [F.lit(0)], keys, strict=True)], "value", "pos", "neg")
    kind = lambda ddl: T.StructType(chunks.schema.fields[: len(keys)] + T.DataType.fromDDL(ddl).fields)
    per_range = F.lit(float(ROWS_PER_RANGE)) if not parts else F.greatest(F.sum("_n").over(Window.partitionBy(F.lit(0))) / parts, F.lit(1.0))
    n = F.octet_length("value") / 8
    step = F.least(F.lit(ROWS_PER_POINT), F.floor(n / 16) + 1).cast("int")
    taken = F.filter(F.sequence(F.floor(step / 2).cast("int"), F.greatest(n.cast("int"), step), step), lambda i: i < n)
    cells = F.transform(taken, lambda i: F.substring("value", i * 8 + 1, F.lit(8)))
    points = chunks.select(*keys, n.cast("bigint").alias("_n"), cells.alias("_points")).mapInArrow(partial(_points, by=keys), kind("_n long, _points array<double>"))
    sized = points.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.array_sort(F.flatten(F.collect_list("_points"))).alias("_s"))
    cuts, known = F.floor(F.col("_n") / per_range).cast("int"), F.size("_s")
    place = lambda i: (i.cast("long") * known / (F.col("_cuts") + 1)).cast("int")
    bounds = F.when((F.col("_cuts") > 0) & (known > 0), F.transform(F.sequence(F.lit(1), F.col("_cuts")), lambda i: F.get("_s", place(i)))).otherwise(F.array().cast("array<double>"))
    # One row per group.
    bounded = stage(sized.withColumn("_cuts", cuts).select(*keys, bounds.alias("_bounds")))
    dealt = join_by(chunks, F.broadcast(bounded), keys)

    per_part = dealt.mapInArrow(partial(_cut, by=keys, scores=False), kind("_part long, _p long, _q long")).groupBy(*keys, "_part").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    # One row per group and range.
    ranges = Window.partitionBy(*keys)
    below = ranges.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(per_part.select(
        *keys, "_part",
        F.coalesce(F.sum("_p").over(below), F.lit(0)).alias("p_below"), F.coalesce(F.sum("_q").over(below), F.lit(0)).alias("n_below"),
        F.sum("_p").over(ranges).alias("P"), F.sum("_q").over(ranges).alias("N"),
    ))
    pieces = dealt.mapInArrow(partial(_cut, by=keys, scores=True), kind(f"_part long, _p long, _q long, {packed}")).drop("_p", "_q")
    placed = join_by(pieces, F.broadcast(offsets), [*keys, "_part"])
    sums = placed.groupBy(*keys, "_part").applyInArrow(lambda table: _range_sums(table, keys), kind("_wins double, _precision double, _p long, _n long"))
    summed = sums.groupBy(*keys[: len(by)]).agg(F.sum("_wins").alias("_wins"), F.sum("_precision").alias("_precision"), F.max("_p").alias("_p"), F.max("_n").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    other = F.lit(one_class).cast("double")
    return summed.select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)],
        F.when(both, F.col("_wins") / (F.col("_p").cast("double") * F.col("_n"))).otherwise(other).alias("roc_auc"),
        F.when(both, F.col("_precision") / F.col("_p")).otherwise(other).alias("pr_auc"),
    )


def ranking_metrics(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), one_class: float | None = None, parts: int | None = None) -> DataFrame:
    """Exact ROC AUC and average precision of a score column, ties included, per group."""
    rows = df.select(*[named(b).alias(b) for b in by], named(y).alias("y"), named(score).cast("double").alias("value"))
    return ranking_areas(rows, by, one_class, parts)


def scored_metrics(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), threshold: float = THRESHOLD, one_class: float | None = None) -> DataFrame:
    """All metrics of a scored table: the prediction is score >= threshold; a NaN score is never predicted 1."""
    decided = df.withColumn("pred", predicted(named(score), threshold))
    keys = list(by) or ["_one"]
    decided = decided if by else decided.withColumn("_one", F.lit(1))
    ranked = ranking_metrics(decided, y, score, keys, one_class)
    out = join_by(binary_metrics(decided, y, "pred", keys), ranked, keys, "left")
    return out if by else out.drop("_one")


def leakage_alarm(metrics: DataFrame) -> DataFrame:
    """Marks runs that are too good: accuracy, F1, AUC or recall above the alarm threshold."""
    best = F.greatest(*[F.col(m) for m in ALARM_METRICS])
    return metrics.withColumn("leakage_alarm", F.coalesce(best > ALARM, F.lit(False)))


def seed_summary(runs: DataFrame, metrics: Sequence[str] = METRICS, by: str = "dataset") -> DataFrame:
    """Mean, sample standard deviation and count per dataset and metric, in long form."""
    long = runs.unpivot([named(by)], [named(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))


def metric_pivot(runs: DataFrame, seeds: Sequence[object], metric: str = "f1", by: str = "dataset", seed: str = "seed") -> DataFrame:
    """One row per dataset, one column per seed."""
    return runs.groupBy(by).pivot(seed, list(seeds)).agg(F.first(metric))


def run_metrics_long(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All numeric columns of the runs as (run keys…, metric, value)."""
    numeric = [f.name for f in runs.schema.fields if f.name not in keys and f.dataType.simpleString() in
               ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")]
    cast = [named(c).cast("int").cast("double").alias(c) if runs.schema[c].dataType.simpleString() == "boolean" else named(c).cast("double").alias(c) for c in numeric]
    return runs.unpivot([named(k) for k in keys], cast, "metric", "value").where(F.col("value").isNotNull())


def early_stopping(history: DataFrame, by: Sequence[str], patience: int = 3) -> DataFrame:
    """Per epoch: best loss so far, whether it improved, epochs since then, and whether training had stopped before.

    ``history`` has one row per run and epoch, so a window per run is small.
    """
    order = Window.partitionBy(*by).orderBy("epoch")
    before = F.min("validation_loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("improved", before.isNull() | (F.col("validation_loss") < before))
    best = F.max(F.when(F.col("improved"), F.struct("epoch", "validation_loss"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("best_epoch", best["epoch"]).withColumn("best_loss", best["validation_loss"])
    counted = counted.withColumn("epoch_rank", F.row_number().over(order))
    rank_of_best = F.max(F.when(F.col("improved"), F.col("epoch_rank"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("without_improvement", F.col("epoch_rank") - rank_of_best)
    stopped = F.coalesce(F.max(F.col("without_improvement") >= patience).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return counted.withColumn("after_stop", stopped).drop("epoch_rank")


def convergence(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per run: best epoch, epochs run, last and best losses, and whether the best epoch was the last one."""
    out = history.groupBy(*by).agg(
        F.min(F.struct("validation_loss", "epoch"))["epoch"].alias("best_epoch"),
        F.max("epoch").alias("epochs_executed"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.max_by("validation_loss", "epoch").alias("final_validation_loss"),
        F.min("validation_loss").alias("best_validation_loss"),
    )
    return out.withColumn("possible_epoch_cap_truncation", F.col("best_epoch") == F.col("epochs_executed"))
