"""Hand-checked values for single operators."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowgate.functions.columns import features_and_target, forbidden_features, predictors
from flowgate.functions.keys import fingerprint, order_key, vector_key
from flowgate.functions.labels import binary_label, literal_label
from flowgate.functions.numbers import finite, ipv4_shaped, not_a_number
from flowgate.operators import duplicates, leakage, metrics, preprocess, profile, quantiles, robustness, sampling
from flowgate.plans import gate, report
from flowgate.staging import stage


def frame(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("numeric"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("category"), (F.col("id") % 2).cast("int").alias("label")
    )


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("values, benign, expected", [
    (["Normal", "DDoS", None], ["normal"], [0, 1, 1]),
    (["Benign_Final", "DDoS-ICMP_Flood"], ["Benign_Final"], [0, 1]),
    (["0", "1", " 0\t", " 0"], [0, "0"], [0, 1, 0, 0]),
])
def test_binary_label(spark, values, benign, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r.y for r in df.select("i", binary_label(F.col("v"), benign).alias("y")).orderBy("i").collect()] == expected


def test_literal_label(spark):
    df = spark.createDataFrame([("ok",), ("bad",)], "v string").select(literal_label(F.col("v"), "ok").alias("y"))
    assert [r.y for r in df.collect()] == [0, 1]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, "f", 0)], "b int, a int, source_file string, target int")
    assert predictors(df, ["target", "source_file"]) == ["b", "a"]
    x, y = features_and_target(df, "target", ["source_file"])
    assert x.columns == ["b", "a"] and y.columns == ["target"]
    assert forbidden_features(["a", "target"], ["target", "label"]) == ["target"]


def test_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 2), ("a", None, 3)], "x string, y string, i int")
    for key in (fingerprint(["x", "y"]), vector_key(["x", "y"]), order_key(["x", "y"], 1), order_key(["x", "y"], 1, fast=True)):
        got = [r.k for r in df.select("i", key.alias("k")).orderBy("i").collect()]
        assert got[0] == got[2] and got[0] != got[1]


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert df.select(vector_key(["x"]).alias("k")).distinct().count() == 1


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("inf",), ("NaN",), ("192.168.0.1",)], "v string")
    rows = df.select("v", not_a_number(F.col("v")).alias("bad"), finite(F.col("v")).alias("f"), ipv4_shaped(F.col("v")).alias("ip")).collect()
    assert [r.bad for r in rows] == [False, True, False, False, False, True]
    assert [r.f for r in rows] == [1.5, None, None, None, None, None]
    assert rows[5].ip and not rows[0].ip


def test_stratified_sample_is_exact_and_repeatable(spark):
    df = frame(spark)
    first = sampling.stratified_sample(df, "label", 100)
    second = sampling.stratified_sample(df.repartition(7), "label", 100)
    assert sorted(first.collect()) == sorted(second.collect())
    assert {r.label: r["count"] for r in first.groupBy("label").count().collect()} == {0: 50, 1: 50}
    assert sampling.stratified_sample(df, "label", None).count() == sampling.stratified_sample(df, "label", 500).count() == 200


def test_row_split_sizes(spark):
    out = sampling.split_rows(frame(spark), "label")
    sizes = {r.split: (r.n, r.mean) for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).collect()}
    assert sizes == {"train": (140, 0.5), "validation": (30, 0.5), "test": (30, 0.5)}


def test_split_ratios_must_add_up(spark):
    with pytest.raises(ValueError):
        sampling.split_rows(frame(spark), "label", ratios=(0.5, 0.2, 0.2))


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 0, 1, 0, 1, 0, 1, 0, 1, 0])), "x int, target int")
    first, second = (sampling.split_groups(d, ["x"], ratios=(0.6, 0.2, 0.2)) for d in (df, df.repartition(5)))
    assert sorted(first.collect()) == sorted(second.collect())
    assert first.groupBy("x").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert first.select("split").distinct().count() == 3
    assert all(r.shared_vectors == 0 for r in sampling.split_overlap(first, ["x"]).collect())


def test_profile_of_small_frame(spark):
    df = spark.createDataFrame([(1.0, 2, 0), (1.0, 2, 0), (math.inf, 2, 1)], "x double, constant int, label int")
    rows = {r.feature: r for r in profile.profile_table(df, "label").collect()}
    assert rows["x"].infinite == 1 and rows["constant"].kind == "constant" and rows["label"].kind is None
    assert one(profile.table_summary(df)).rows == 3
    assert one(duplicates.exact_duplicates(df)).duplicate_rows == 1


def test_fit_uses_training_rows_only(spark):
    train, other = frame(spark, 100), spark.createDataFrame([(1000, "unseen")], "numeric long, category string")
    prep = preprocess.fit(train, ["numeric"], ["category"])
    assert prep.numeric[0].mean == 49.5
    out = one(prep.transform(other))
    assert out["categorical__category_a"] == out["categorical__category_b"] == 0.0
    assert preprocess.fit_numeric(spark.createDataFrame([(0.0,), (2.0,)], "x double"), ["x"])[0].mean == 1.0


def test_fitted_state_survives_a_table(spark):
    prep = preprocess.fit(frame(spark, 50), ["numeric"], ["category"])
    assert preprocess.Preprocessor.load(prep.parameters(spark)) == prep
    assert one(prep.assemble(frame(spark, 1))).features == Vectors.dense([prep.transform(frame(spark, 1)).first()[0], 1.0, 0.0])


def test_constant_and_missing_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(5.0, None, None), (5.0, None, None)], "a double, b double, c string")
    prep = preprocess.fit(df, ["a", "b"], ["c"])
    assert prep.transform(df).collect() == [(0.0, 0.0), (0.0, 0.0)]


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0, 0, .1), (0, 1, .7), (1, 1, .8), (1, 1, .9)], "y int, pred int, score double")
    out = one(metrics.binary_metrics(df))
    assert out.attack_recall == 1.0 and out.false_positive_rate == 0.5
    assert (out.tp, out.tn, out.fp, out.fn) == (2, 1, 1, 0)
    assert one(metrics.ranking_metrics(df)).roc_auc == 1.0
    assert metrics.confusion_matrix(df).collect() == [(0, 1, 1), (1, 0, 2)]


def test_ranking_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0, .5), (1, .5), (1, .5), (0, .1)], "y int, score double")
    out = one(metrics.ranking_metrics(df))
    assert out.roc_auc == 0.75 and out.pr_auc == pytest.approx(2 / 3)
    ones = df.where("y = 1")
    assert one(metrics.ranking_metrics(ones)).roc_auc is None
    assert one(metrics.ranking_metrics(ones, one_class=0.0)).pr_auc == 0.0


def test_ranking_equals_pairwise_definition(spark):
    df = spark.range(400).select((F.abs(F.xxhash64("id")) % 7).cast("double").alias("score"), (F.abs(F.xxhash64("id", F.lit(1))) % 2).cast("int").alias("y"))
    rows = df.collect()
    pos, neg = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for parts in (None, 2, 3, 64):
        assert one(metrics.ranking_metrics(df, parts=parts)).roc_auc == pytest.approx(expected)


def test_ranking_of_groups_over_many_ranges(spark):
    df = spark.range(600).select(
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("h"),
        (F.abs(F.xxhash64("id")) % 50).cast("double").alias("score"), (F.abs(F.xxhash64("id", F.lit(1))) % 2).cast("int").alias("y"),
    )
    few, many = ({(r.g, r.h): (r.roc_auc, r.pr_auc) for r in metrics.ranking_metrics(df, by=["g", "h"], parts=n).collect()} for n in (1, 37))
    assert len(few) == 12 and {k: pytest.approx(v) for k, v in few.items()} == many
    rows = [r for r in df.collect() if r.g is None and r.h == 2]
    pos, neg = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    assert few[None, 2][0] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_exact_quantiles_do_not_depend_on_cells(spark):
    values = [float((i * 7919) % 1009) for i in range(1000)] + [3.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    ordered = sorted(values)

    def expected(p):
        at = (len(ordered) - 1) * p
        low = int(at)
        return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)

    for read in (1, 8, 100_000):
        got = {r.probability: r["quantile"] for r in quantiles.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.99, 1.0], read).collect()}
        assert got == pytest.approx({p: expected(p) for p in got})


@pytest.mark.parametrize("read", [1, 20_000])
def test_quantiles_of_all_kinds_of_columns(spark, read, monkeypatch):
    """Equal and distinct values, both signs, extreme magnitudes, nulls, text, names with dots."""
    if read == 1:
        monkeypatch.setattr(quantiles, "PARTS", 3)
    n = 3000
    made = {
        "equal": [5.0] * n, "dis.tinct": [float(i * 7919 % n) for i in range(n)], "signs": [(-1.0) ** i * i / 7 for i in range(n)],
        "wide": [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(n)], "tiny": [5e-324 * (i % 5) for i in range(n)], "close": [1.0 + i * 2.3e-16 for i in range(n)],
        "odd": [None, float("nan"), float("inf"), -0.0, 0.0, 2.0] * (n // 6), "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*made.values())), ", ".join(f"`{c}` double" for c in made)).repartition(5)
    points = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {(r.feature, r.probability): r["quantile"] for r in quantiles.exact_quantiles(df, list(made), points, read).collect()}
    for c, column in made.items():
        ordered = sorted(x for x in column if x is not None and abs(x) < float("inf"))
        for p in points:
            if not ordered:
                assert got[c, p] is None
                continue
            at = (len(ordered) - 1) * p
            low = ordered[int(at)]
            assert got[c, p] == low + (ordered[min(int(at) + 1, len(ordered) - 1)] - low) * (at - int(at))


def test_quantiles_and_ranking_of_a_million(spark):
    df = spark.range(1_000_000).select(F.lit(3.5).alias("equal"), (F.col("id") * 7919 % 1_000_000).cast("double").alias("score"), (F.col("id") * 7919 % 1_000_000 % 2).cast("int").alias("y"))
    got = {(r.feature, r.probability): r["quantile"] for r in quantiles.exact_quantiles(df, ["equal", "score"], [0.1, 0.5]).collect()}
    assert got == {("equal", 0.1): 3.5, ("equal", 0.5): 3.5, ("score", 0.1): pytest.approx(99999.9), ("score", 0.5): 499999.5}
    assert one(metrics.ranking_metrics(df)).roc_auc == pytest.approx(0.5 + 1e-6, abs=1e-9)
    plan = quantiles.exact_quantiles(df, ["score"], [0.5])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_packing_of_very_many_classes(spark):
    """5,000 classes: a flat plan, and quotas met by whole groups, smallest first."""
    df = spark.range(40_000).select("id", (F.col("id") % 5000).cast("int").alias("y"), F.floor(F.col("id") / 5000 / 2).alias("g"))
    out = sampling.pack_groups(df, "y", ["g", "y"], 20_000)
    assert out.groupBy("y").count().where("count <> 4").count() == 0 and out.groupBy("y", "g").count().where("count <> 2").count() == 0


def test_vocabularies_have_no_cap(spark):
    """5,000 values in one of two features: that one becomes a sparse vector, the other one columns."""
    df = spark.range(10_000).select(F.concat(F.lit("v"), F.lpad(F.col("id") % 5000, 4, "0")).alias("many"), (F.col("id") % 3).cast("string").alias("few"), F.col("id").cast("double").alias("n"))
    fitted = preprocess.fit(df, ["n"], ["many", "few"])
    again = preprocess.Preprocessor.load(fitted.parameters(spark))
    assert again == fitted and [c.sparse for c in fitted.categorical] == [True, False] and len(fitted.categorical[0].vocabulary) == 5000
    new = spark.createDataFrame([("v0007", "1", 1.0), ("unknown", "9", 2.0), (None, None, None)], "many string, few string, n double")
    for p in (fitted, again):
        out = p.transform(new, keep=["n"])
        assert out.columns == ["n", "numeric__n", "categorical__few_0", "categorical__few_1", "categorical__few_2", "categorical__many"]
        vectors = [r["categorical__many"] for r in out.collect()]
        assert [(v.size, v.indices.tolist()) for v in vectors] == [(5000, [7]), (5000, []), (5000, [0])]
        assert [r.features.size for r in p.assemble(new).collect()] == [5004] * 3
    assert {r.raw_feature: len(r.output_features) for r in fitted.lineage(spark).collect()} == {"n": 1, "many": 1, "few": 3}


def test_early_stopping(spark):
    losses = [0.9, 0.5, 0.6, 0.5, 0.7, 0.4]
    df = spark.createDataFrame([("d", i + 1, 1.0, v) for i, v in enumerate(losses)], "dataset string, epoch int, train_loss double, validation_loss double")
    rows = metrics.early_stopping(df, ["dataset"], patience=3).orderBy("epoch").collect()
    assert [r.without_improvement for r in rows] == [0, 0, 1, 2, 3, 0]
    assert [r.after_stop for r in rows] == [False] * 5 + [True]
    assert one(metrics.convergence(df, ["dataset"])).possible_epoch_cap_truncation


def test_constraints(spark):
    df = spark.createDataFrame([(0.2, 0.0, 2.0, 0.9, 0.7, 2.7)], "o0 double, o1 double, o2 double, c0 double, c1 double, c2 double")
    pairs = {"c0": "o0", "c1": "o1", "c2": "o2"}
    bounds = ({c: 0.0 for c in pairs}, {c: 3.0 for c in pairs})
    out = robustness.enforce_constraints(df, pairs, ["c0"], ["c1"], ["c2"], *bounds)
    assert (lambda r: (r.c0, r.c1, r.c2))(one(out)) == (0.2, 1.0, 3.0)
    assert all(r.holds for r in robustness.constraint_violations(out, pairs, ["c0"], *bounds).collect())
    assert not all(r.holds for r in robustness.constraint_violations(df, pairs, ["c0"], *bounds).collect())


@pytest.mark.parametrize("discrete", [False, True])
@pytest.mark.parametrize("sign", [1.0, -1.0, 0.0])
@pytest.mark.parametrize("steps, fraction", [(1, 1.0), (2, 0.25), (3, 0.1), (20, 0.25)])
def test_shortened_attack_equals_all_its_steps(spark, discrete, sign, steps, fraction):
    numeric = preprocess.Numeric("x", 0.0, 25.4, 14.4)
    box = robustness.Range(numeric, 1.0, 50.0, discrete)
    df = spark.range(300).select(
        ((F.col("id") % 50 + 1 - 25.4) / 14.4).alias("z"), (F.col("id") * 0.37 % 1).alias("u"), (F.col("id") % 7 * 0.013 + 0.003).alias("b")
    )
    e = box.epsilon(F.col("b"))
    short = robustness.pgd(F.col("z"), e, sign, box, F.col("u"), steps, fraction)
    slow = F.col("z") + (F.col("u") * 2 - 1) * e
    for _ in range(steps):
        slow = robustness.project(slow - e * fraction * sign, F.col("z"), e, box)
    worst = df.select(F.max(F.abs(short - slow)).alias("d")).first().d
    assert worst < 1e-9


def test_perturbation_stays_in_budget_and_range(spark):
    rows = spark.range(500).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"), "id")
    numeric = preprocess.fit_numeric(rows, ["x"])
    ranges = robustness.fit_ranges(rows, numeric)
    grid = robustness.attack_grid(rows, "y", robustness.LinearScorer({"x": 1.0}), numeric, ranges, ["id"], keep=["id"]).collect()
    width = (39.0 - 0.0) / numeric[0].scale
    assert len(grid) == 3000 and all(r.violations == 0 for r in grid)
    assert all(r.linf <= r.budget * width + 1e-9 for r in grid)
    assert all(r.changed == 0 for r in grid if r.y == 0)


THRESHOLDS = {"min_clean_f1": .9, "min_clean_attack_recall": .9, "min_adversarial_attack_recall": .7, "max_relative_f1_drop": .2}


@pytest.mark.parametrize("recall, drop, expected", [(.8, .1, "PASS"), (.6, .3, "BLOCK")])
def test_basic_gate(spark, recall, drop, expected):
    df = spark.createDataFrame([(.95, .96, recall, drop)], "clean_f1 double, clean_attack_recall double, adversarial_attack_recall double, relative_f1_drop double")
    out = one(gate.basic_gate(df, THRESHOLDS))
    assert out.decision == expected
    assert out.failed_conditions == ([] if expected == "PASS" else ["adversarial_attack_recall", "relative_f1_drop"])


def runs(spark, recall=0.52278, rate=0.47527, drop=0.47350, conditions=6, violations=0):
    grid = [(a, b) for a in ("FGSM", "PGD") for b in (.01, .03, .05)][:conditions]
    rows = [("ton", 42, a, b, recall, rate, drop, violations, 1.0) for a, b in grid]
    return spark.createDataFrame(
        rows, "dataset string, seed int, attack string, budget double, attack_recall double, attack_success_rate double, "
        "clean_to_adv_attack_recall_drop double, semantic_constraint_violations bigint, runtime_seconds double"
    )


def audited(worst, overlap=0, leak=False):
    return worst.withColumns({"fingerprint_overlap": F.lit(overlap), "confirmed_leakage": F.lit(leak)})


def test_published_gate_decision(spark):
    out = one(gate.decisions(audited(gate.worst_cases(runs(spark)))))
    assert out.decision == "BLOCK"
    assert out.failed_criteria == "BLOCK_LOW_ROBUST_RECALL;BLOCK_HIGH_ATTACK_SUCCESS_RATE;BLOCK_EXCESSIVE_RECALL_DROP"
    assert len(out.policy_hash) == 64


@pytest.mark.parametrize("change, expected", [
    ({}, "PASS_ALL_CRITERIA"), ({"conditions": 5}, "BLOCK_ARTIFACT_INTEGRITY"), ({"violations": 1}, "BLOCK_ARTIFACT_INTEGRITY"),
    ({"recall": float("nan")}, "BLOCK_LOW_CLEAN_RECALL;BLOCK_LOW_ROBUST_RECALL"), ({"rate": float("nan")}, "BLOCK_HIGH_ATTACK_SUCCESS_RATE"),
    ({"drop": None}, "BLOCK_LOW_CLEAN_RECALL;BLOCK_EXCESSIVE_RECALL_DROP"), ({"violations": None}, "BLOCK_ARTIFACT_INTEGRITY"),
])
def test_gate_integrity(spark, change, expected):
    fine = {"recall": .95, "rate": .0, "drop": .02}
    out = one(gate.decisions(audited(gate.worst_cases(runs(spark, **{**fine, **change})))))
    assert ";".join(out.reason_codes) == expected


def test_one_unknown_condition_blocks(spark):
    good = runs(spark, .95, .0, .02)
    rows = good.withColumn("attack_recall", F.when((F.col("attack") == "PGD") & (F.col("budget") == 0.03), float("nan")).otherwise(F.col("attack_recall")))
    out = one(gate.decisions(audited(gate.worst_cases(rows))))
    assert out.reason_codes == ["BLOCK_LOW_ROBUST_RECALL"]
    assert one(gate.sensitivity(audited(gate.worst_cases(rows)), recalls=[.0], successes=[1.])).models_passed == 0


def test_required_evidence_that_is_missing_blocks(spark):
    worst = gate.worst_cases(runs(spark, .95, .0, .02))
    assert one(gate.decisions(worst)).reason_codes == ["BLOCK_ARTIFACT_INTEGRITY"]
    assert one(gate.decisions(audited(worst, None))).reason_codes == ["BLOCK_ARTIFACT_INTEGRITY"]
    assert one(gate.decisions(audited(worst, 0, True))).reason_codes == ["BLOCK_ARTIFACT_INTEGRITY"]
    loose = {**gate.POLICY, "integrity": {**gate.POLICY["integrity"], "require_zero_fingerprint_overlap": False, "block_confirmed_leakage": False}}
    assert one(gate.decisions(worst, loose)).reason_codes == ["PASS_ALL_CRITERIA"]


def test_basic_gate_blocks_unknown_figures(spark):
    models = spark.createDataFrame([(float("nan"), .99, .99, .01), (.99, None, .99, .01), (.99, .99, .99, .01)], "clean_f1 double, clean_attack_recall double, adversarial_attack_recall double, relative_f1_drop double")
    limits = {"min_clean_f1": .9, "min_clean_attack_recall": .9, "min_adversarial_attack_recall": .8, "max_relative_f1_drop": .2}
    assert [r.decision for r in gate.basic_gate(models, limits).collect()] == ["BLOCK", "BLOCK", "PASS"]


def test_nan_scores_are_no_attacks(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, .9), (0, float("nan")), (0, None)], "y int, score double")
    out = one(metrics.scored_metrics(df))
    assert (out.tp, out.fn, out.fp, out.tn) == (1, 1, 0, 1)


SIGNED = [(0.0, "a|b", "c", 0), (-0.0, "a|b", "c", 0), (0.0, "a", "b|c", 1), (1.0, None, "x", 0), (1.0, "\\N", "x", 1), (1.0, "<null>", "x", 0), (-0.0, "a", "b|c", 1), (2.0, "-0.0", "x", 0), (2.0, "0.0", "x", 1)]


def test_order_keys_are_equal_exactly_where_groups_are(spark):
    df = spark.createDataFrame(SIGNED, "v double, p string, q string, y int")
    groups = df.groupBy("v", "p", "q").count().count()
    for fast in (False, True):
        assert df.select(order_key(["v", "p", "q"], 1, fast=fast).alias("k")).distinct().count() == groups == 7


def test_splits_share_no_vector_whatever_the_signs_of_zero(spark):
    rows = [(float(-0.0 if i % 2 else 0.0), float(i % 300), "a|" if i % 3 else None, 0 if (i % 300) % 2 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "z double, v double, t string, y int")
    found = []
    for parts in (1, 9):
        dealt = df.repartition(parts)
        for split in (sampling.split_label_groups(dealt, "y", ["z", "v", "t"]), sampling.split_groups(dealt, ["z", "v", "t"])):
            assert all(r.shared_vectors == 0 for r in sampling.split_overlap(split, ["z", "v", "t"]).collect())
        found.append(sorted(map(repr, sampling.pack_groups(dealt, "y", ["z", "v", "t"], 1000).select(F.col("z") + 0.0, "v", "t", "y").collect())))
    assert found[0] == found[1]


def test_shuffled_rows_with_ties_are_repeatable(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    assert len({tuple(r.v for r in sampling.shuffled(df.repartition(n), key=["k"]).collect()) for n in (2, 5)}) == 1


def test_ranges_skip_nan(spark):
    from flowgate.operators.preprocess import Numeric

    df = spark.createDataFrame([(1.0,), (5.0,), (float("nan"),), (None,)], "v double")
    found = robustness.fit_ranges(df, [Numeric("v", 0.0, 0.0, 1.0)])["v"]
    assert (found.low, found.high) == (1.0, 5.0)


def test_gate_reads_evidence_columns(spark):
    worst = gate.worst_cases(runs(spark, .95, .0, .02)).withColumns({"fingerprint_overlap": F.lit(3), "confirmed_leakage": F.lit(False)})
    assert one(gate.decisions(worst)).reason_codes == ["BLOCK_ARTIFACT_INTEGRITY"]


def test_completeness_counts_missing_runs(spark):
    grid = report.run_grid(spark, ["ton"], [42, 123], ["FGSM", "PGD"], [.01, .03, .05])
    out = one(report.completeness(report.run_manifest(grid, runs(spark))))
    assert (out.expected_conditions, out.completed_conditions, out.failed_conditions, out.gate_decisions_expected) == (12, 6, 6, 2)


def test_proxy_flag(spark):
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).alias("tell"), (F.col("id") % 5).alias("fair"), F.lit("t").alias("text"))
    out = {r.feature: r for r in leakage.univariate_leakage(df, ["tell", "fair", "text"], "y").collect()}
    assert out["tell"].status == "POTENTIAL_PROXY" and out["tell"].univariate_auc == 1.0
    assert out["fair"].status == "NORMAL" and out["text"].univariate_auc is None


def test_missing_scores_are_left_out_of_the_ranking(spark):
    df = spark.createDataFrame([(0, .1), (1, .9), (1, None), (0, None), (None, .5)], "y int, score double")
    assert one(metrics.ranking_metrics(df)) == (1.0, 1.0)
    assert one(metrics.ranking_metrics(df.where("score is null"))) == (None, None)


def test_splits_of_very_many_classes(spark):
    """The plan does not nest with the number of classes; quotas are exact in each."""
    df = spark.range(9000).select("id", (F.col("id") % 3000).cast("int").alias("y"))
    out = sampling.split_rows(df, "y", key=["id"], ratios=(1 / 3, 1 / 3, 1 / 3))
    assert out.groupBy("split").count().count() == 3 and out.groupBy("y").agg(F.countDistinct("split").alias("n")).where("n <> 3").count() == 0
    assert sampling.stratified_sample(df, "y", 3000, key=["id"]).groupBy("y").count().where("count <> 1").count() == 0


def test_reports_are_sorted(spark):
    both = runs(spark).unionByName(runs(spark).withColumn("seed", F.lit(7))).unionByName(runs(spark).withColumn("dataset", F.lit("edge")))
    decided = gate.decisions(audited(gate.worst_cases(both)))
    for out in (report.gate_table(decided, report.worst_case_table(both)), report.master_results(both.where("attack = 'FGSM' and budget = 0.01").drop("attack", "budget"), decided)):
        assert [(r.dataset, r.seed) for r in out.collect()] == [("edge", 42), ("ton", 7), ("ton", 42)]


def test_joined_rows_are_stored_once_for_fitting(spark, sf):
    """Fitting and transforming read the stored rows; the join behind them is made once."""
    from catalog import samples

    rows, prep = samples.fitted(spark, sf)
    for df in (rows, prep.transform(rows, [*samples.ROW, "split"])):
        assert not any("lineitem" in f or "orders" in f for f in df.inputFiles())
    assert rows.count() == samples.order_lines(spark, sf).count()


def test_attack_scores_carry_no_sums(spark, sf, monkeypatch):
    """What is kept for each score is its counts: all other figures come from one row per condition and task."""
    from catalog import models
    from flowgate.operators import metrics

    stored, stage = [], metrics.stage
    monkeypatch.setattr(metrics, "stage", lambda df: stored.append(df.columns) or stage(df))
    monkeypatch.setattr(robustness, "stage", lambda df: stored.append(df.columns) or stage(df), raising=False)
    assert models.attack_runs(spark, sf, ranking=True).count() > 0
    assert stored[0] == ["dataset", "seed", "attack", "budget", "value", "pos", "neg"] and max(map(len, stored)) <= 9


def test_ranking_packs_scores_into_chunks(spark, monkeypatch):
    """Different scores get no stored or shuffled row each, whatever the sizes of chunks and ranges, and the areas are those of the definition."""
    kept = []
    monkeypatch.setattr(metrics, "stage", lambda df: kept.append(stage(df)) or kept[-1])
    e = F.col("id")
    df = stage(spark.range(20_000, numPartitions=3).select(
        F.when(e % 3 > 0, e % 3).cast("double").alias("a.g"),
        F.when(e % 41 == 0, None).when(e % 37 == 0, F.lit(float("nan"))).when(e % 31 == 0, F.lit(-0.0)).when(e % 29 == 0, F.lit(0.0)).otherwise(F.xxhash64("id") / F.lit(1e15)).alias("score"),
        F.when(e % 19 > 0, F.abs(F.xxhash64("id", F.lit(1))) % 2).cast("int").alias("y"),
    ))
    got = {r[0]: (r.roc_auc, r.pr_auc) for r in metrics.ranking_metrics(df, by=["a.g"]).collect()}
    assert max(k.count() for k in kept) <= 3 * 3
    monkeypatch.setattr(metrics, "ROWS_PER_CHUNK", 900)
    monkeypatch.setattr(metrics, "ROWS_PER_RANGE", 700)
    cut = {r[0]: (r.roc_auc, r.pr_auc) for r in metrics.ranking_metrics(df, by=["a.g"]).collect()}
    for g in (None, 1.0, 2.0):
        rows = [(float("inf") if r.score != r.score else r.score, r.y) for r in df.collect() if r[0] == g and r.score is not None and r.y is not None]
        wins, precision, tp, above, below = 0.0, 0.0, 0, 0, sum(1 - y for _, y in rows)
        for _, tied in itertools.groupby(sorted(rows, reverse=True), lambda r: r[0]):
            ys = [y for _, y in tied]
            tp, above, below = tp + sum(ys), above + len(ys), below - len(ys) + sum(ys)
            wins, precision = wins + sum(ys) * (below + (len(ys) - sum(ys)) / 2), precision + sum(ys) * tp / above
        expected = (wins / (tp * (len(rows) - tp)), precision / tp)
        assert got[g] == pytest.approx(expected) and cut[g] == pytest.approx(expected)
    none = df.limit(0)
    assert metrics.ranking_metrics(none, by=["a.g"]).count() == 0 and one(metrics.ranking_metrics(none)) == (None, None)
