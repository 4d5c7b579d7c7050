"""Stored sketches: exact parts equal the exact profile, estimates keep their bounds, and parts are read once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import catalog
from flowgate.functions.keys import vector_key
from flowgate.operators import profile, sketches, verdicts
from flowgate.staging import stage, stage_path


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 50 > 0, (F.abs(F.xxhash64("id")) % 100_000) / 7.0)
    odd = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("id") % 10)
    return stage(spark.range(60_000).select("id", x.alias("x.y"), odd.alias("odd"), (F.col("id") % 4000).cast("string").alias("text"), F.lit(None).cast("double").alias("none"), (F.col("id") % 3).alias("day")))


def test_merged_parts_equal_one_profile(spark, rows):
    store, columns = stage_path(spark, "sketches"), ["x.y", "odd", "text", "none"]
    assert all(sketches.add_part(rows.where(F.col("day") == d), columns, f"day {d}", store) for d in range(3))
    assert not sketches.add_part(rows, columns, "day 1", store)
    found = {r.feature: r for r in sketches.profile(spark, store).collect()}
    exact = {r.feature: r for r in profile.column_profile(rows, columns, approximate=False, text_numeric=["text"]).collect()}
    distinct = {r.feature: r.cardinality for r in profile.value_summary(rows, columns).collect()}
    for c in columns:
        f, e = found[c], exact[c]
        assert (f.rows, f.missing, f["min"], f["max"]) == (60_000, e.missing, e["min"], e["max"])
        assert (f["mean"], f["std"]) == (pytest.approx(e["mean"]), pytest.approx(e["std"]))
        assert abs(f.cardinality_approx - (distinct[c] - (e.missing > 0))) <= 0.05 * distinct[c] + 1
    values = sorted(r[0] for r in rows.where("`x.y` is not null").select("`x.y`").collect())
    for p, q in zip(sketches.POINTS, found["x.y"].percentiles_approx):
        rank = sum(v <= q for v in values) / len(values)
        assert abs(rank - p) < 0.015
    assert found["none"].percentiles_approx is None and found["none"]["mean"] is None


def test_a_new_part_is_read_alone(spark, tmp_path, rows):
    """The first file is gone when the second one is added: its sketches are enough."""
    import shutil

    store, columns = str(tmp_path / "store"), ["odd", "text"]
    for d in (0, 1):
        rows.where(F.col("day") == d).write.parquet(str(tmp_path / f"file{d}"))
    sketches.add_part(spark.read.parquet(str(tmp_path / "file0")), columns, "file0", store)
    shutil.rmtree(tmp_path / "file0")
    sketches.add_part(spark.read.parquet(str(tmp_path / "file1")), columns, "file1", store)
    found = {r.feature: r for r in sketches.profile(spark, store).collect()}
    assert found["text"].rows == 40_000 and sketches.stored_parts(spark, store) == {"file0", "file1"}


def test_bitmap_keeps_all_listed_rows_and_few_others(spark, monkeypatch):
    rows = stage(spark.range(200_000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 50_000).alias("k"), F.lit("x").alias("_bit")))
    listed = spark.range(0, 50_000, 100).select(F.col("id").alias("k"))
    keys = listed.select(vector_key(["k"]).alias("_key"))
    tagged = rows.withColumn("_key", vector_key(["k"]))
    left = verdicts.maybe_listed(tagged, keys, 500)
    wanted = rows.join(listed, "k", "left_semi").count()
    assert left.join(listed, "k", "left_semi").count() == wanted and left.columns == tagged.columns
    assert left.count() < 200_000 / 10
    small = {r.id for r in verdicts.keep_listed(rows, listed, ["k"]).collect()}
    assert {r.id for r in verdicts.keep_listed(rows, listed, ["k"], max_broadcast=10).collect()} == small and len(small) == wanted
    monkeypatch.setattr(verdicts, "BITMAPS", 1)
    everything = spark.range(50_000).select(F.col("id").alias("k"))
    assert verdicts.keep_listed(rows, everything, ["k"], max_broadcast=10).count() == 160_000


def test_the_sketched_profile_is_judged_against_exact_counts(spark, sf, monkeypatch):
    query = catalog.QUERIES["column_profile_sketched"]
    found = query(spark, sf).collect()
    assert {"cardinality_approx", "percentiles_approx", "mean", "cardinality_close", "quantiles_close"} <= set(found[0].asDict())
    assert all(r.cardinality_close for r in found) and all(r.quantiles_close for r in found if r.analysis_dtype)
    # a coarse sketch is noticed
    whole = profile.column_profile
    monkeypatch.setattr(profile, "column_profile", lambda df: whole(df, accuracy=2))
    assert not all(r.quantiles_close for r in query(spark, sf).collect() if r.analysis_dtype)
