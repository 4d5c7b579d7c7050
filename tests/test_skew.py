"""A third of all rows under one key: results stay whole, and do not depend on the partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowgate.functions.keys import order_key, vector_key
from flowgate.operators import cuts, duplicates, sampling, verdicts

N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """10,000 copies of one row, the rest spread over 500 keys; some keys carry both labels."""
    i = F.col("id")
    key = F.when(i < N // 3, 0).otherwise(1 + i % 500)
    label = F.when(key % 10 == 3, (F.floor(i / 500) % 2).cast("int")).otherwise((key % 3 == 0).cast("int"))
    return spark.range(N).repartition(6).select(key.alias("k"), label.alias("y")).cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"max_broadcast": 0}, {"max_broadcast": 0, "hot_groups": 1}, {"max_broadcast": 0, "hot_groups": 1000}])
def test_drop_conflicts_whichever_join(hot, limits):
    wanted = [r for r in rows_of(hot) if not (r[0] % 10 == 3)]
    assert rows_of(verdicts.drop_conflicts(hot, ["k"], "y", **limits)) == wanted


def test_hot_rows_do_not_meet_in_one_task(spark, hot):
    """In the shuffled join, no task receives more than its share of the hot group."""
    groups = duplicates.vector_groups(hot, ["k"], "y").withColumn("_keep", F.col(duplicates.LABELS) == 1)
    keyed = hot.withColumn("_key", vector_key(["k"]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = verdicts.keep_rows(keyed, groups.withColumnRenamed("key", "_key"), "_key", "_keep", duplicates.N, max_broadcast=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("listed", [3, 400])
def test_listed_rows_whichever_join(spark, hot, listed):
    keys = spark.range(listed).select(F.col("id").cast("int").alias("k"))
    rows = hot.select("k", "y")
    wanted = [r for r in rows_of(rows) if r[0] < listed]
    assert rows_of(verdicts.keep_listed(rows, keys, ["k"])) == wanted
    assert rows_of(verdicts.keep_listed(rows, keys, ["k"], max_broadcast=0)) == wanted


@pytest.mark.parametrize("n", [7, 1000, 9999, 20_001])
def test_sample_is_exact_with_copies(hot, n):
    sample = sampling.stratified_sample(hot, "y", n)
    population = {r.y: r["count"] for r in hot.groupBy("y").count().collect()}
    got = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    assert sum(got.values()) == n
    assert all(abs(got[c] - n * v / N) <= 1 for c, v in population.items())
    # Never more copies than there are.
    left = {(r.k, r.y): r["count"] for r in hot.groupBy("k", "y").count().collect()}
    assert all(r["count"] <= left[r.k, r.y] for r in sample.groupBy("k", "y").count().collect())


def test_row_split_is_exact_with_copies(hot):
    out = sampling.split_rows(hot, "y")
    assert rows_of(out.drop("split")) == rows_of(hot)
    population = {r.y: r["count"] for r in hot.groupBy("y").count().collect()}
    for r in out.groupBy("y", "split").count().collect():
        assert abs(r["count"] - population[r.y] * dict(zip(sampling.SPLITS, sampling.RATIOS))[r.split]) <= 1


def test_boundary_key_with_different_rows(spark):
    """All rows share the order key; the exact cut then falls back on the other columns."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    first, second = (sampling.stratified_sample(d, "y", 1234, key=["k"]) for d in (df, df.repartition(9)))
    assert first.count() == 1234 and rows_of(first) == rows_of(second)


def test_pack_groups_against_brute_force(spark, hot):
    rows = hot.select("k", (F.col("k") % 2).cast("int").alias("y"))
    sizes = {(r.y, r.k): (r["count"], r.o) for r in rows.withColumn("o", order_key(["k"], 42)).groupBy("y", "k", "o").count().collect()}
    totals = {y: sum(n for (c, _), (n, _) in sizes.items() if c == y) for y in (0, 1)}
    for n in (500, 12_345, 25_000):
        quota = {y: max(1, round(n * t / N)) for y, t in totals.items()}
        quota[1] += n - sum(quota.values())
        wanted = set()
        for y in (0, 1):
            filled = 0
            for size, order, k in sorted((s, o, k) for (c, k), (s, o) in sizes.items() if c == y):
                filled += size
                if filled > quota[y]:
                    break
                wanted.add((y, k))
        for limits in ({}, {"max_broadcast": 0, "hot_groups": 3}):
            out = sampling.pack_groups(rows, "y", ["k"], n, **limits)
            assert {(r.y, r.k) for r in out.distinct().collect()} == wanted
            assert out.count() == sum(sizes[g][0] for g in wanted)


@pytest.mark.parametrize("keys, step", [(cuts.MAX_KEYS, 3), (5, 3), (1, 2)])
def test_cuts_against_brute_force(spark, monkeypatch, keys, step):
    """The same cut whether cells are read at once or narrowed digit by digit."""
    monkeypatch.setattr(cuts, "MAX_KEYS", keys)
    monkeypatch.setattr(cuts, "STEP_DIGITS", step)
    df = spark.range(800).select((F.col("id") % 2).cast("int").alias("y"), F.md5((F.col("id") % 300).cast("string").cast("binary")).alias("k"), (F.col("id") % 5).alias("w"))
    cells: dict = {}
    for r in df.collect():
        cells[r.y, r.k] = cells.get((r.y, r.k), 0) + r.w
    targets = {(0, 0): 100.0, (0, 1): 333.5, (1, 0): 0.0, (1, 1): 1e9}
    got = cuts.find_cuts(df, targets, "y", "k", "w")
    for (y, j), target in targets.items():
        before, last = 0, None
        for k in sorted(k for c, k in cells if c == y):
            if before < target:
                last = (k, before, cells[y, k])
            before += cells[y, k]
        assert (last is None) == ((y, j) not in got)
        if last:
            assert (got[y, j].key, got[y, j].before, got[y, j].rows) == last


def test_duplicate_figures_add_up(hot):
    groups = duplicates.vector_groups(hot, ["k"], "y")
    r = duplicates.duplicate_audit(groups).first()
    assert r.rows_total == N and r.max_duplicate_group_size == N // 3
    assert r.duplicate_rows == N - r.unique_feature_vectors
    summary = duplicates.label_summary(groups).collect()
    assert sum(s.original_rows for s in summary) == N
    assert sum(s.conflicting_rows for s in summary) == r.cross_label_duplicate_rows
    exact = duplicates.duplicate_audit(duplicates.vector_groups(hot, ["k"], "y", exact_key=True)).first()
    assert exact == r


def test_missing_labels_are_a_label_of_their_own(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (2, None), (3, 1)], "k int, y int")
    groups = duplicates.vector_groups(df, ["k"], "y", exact_key=True)
    assert {r.k: r.labels for r in duplicates.vector_labels(groups).collect()} == {1: [0, None], 2: [None], 3: [1]}
    assert duplicates.duplicate_audit(groups).first().cross_label_duplicate_groups == 1


def test_listed_missing_keys_match_whichever_join(spark):
    rows = spark.createDataFrame([(1, 7), (None, 8), (2, 9)], "k int, v int")
    keys = spark.createDataFrame([(None,), (2,)], "k bigint")
    for limit in (10, 0):
        assert sorted(r.v for r in verdicts.keep_listed(rows, keys, ["k"], max_broadcast=limit).collect()) == [8, 9]
