"""The network's weights as numpy, its gradient, attacks on it, and the audit models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowgate.operators import model as T
from flowgate.operators import preprocess
from flowgate.operators.robustness import attack_metrics
from flowgate.plans import materialize as M
from flowgate.staging import stage


@pytest.fixture(scope="module")
def rows(spark):
    x = [(F.abs(F.xxhash64("id", F.lit(i))) % 1000 / 500.0 - 1.0) for i in range(3)]
    df = spark.range(600).select("id", F.array(*x).alias("a"))
    return stage(df.select("id", (F.col("a")[0] + F.col("a")[1] * 0.5 > 0).cast("int").alias("y"), array_to_vector("a").alias("features")))


@pytest.fixture(scope="module")
def trained(rows):
    return T.train(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), "y", hidden=(6, 4), max_epochs=4, iterations=10)


def test_training_learns_and_keeps_the_best_epoch(rows, trained):
    model, history = trained
    losses = [r.validation_loss for r in history.orderBy("epoch").collect()]
    assert T.log_loss(model, rows.where("id % 3 = 0"), "y") == pytest.approx(min(losses))
    out = T.score(model, rows, ["id", "y"])
    assert out.where("pred = y").count() > 540


def test_numpy_network_equals_the_model(rows, trained):
    model, _ = trained
    net = T.layer_weights(model.weights.toArray(), list(model.getLayers()))
    found = model.transform(rows.limit(50)).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    x, p = np.array([r.x for r in found]), np.array([r.p for r in found])
    assert np.allclose(T.forward(x, net)[0], p, atol=1e-9)
    gradient, h = T.benign_gradient(x, net), 1e-6
    for i in range(x.shape[1]):
        up, down = x.copy(), x.copy()
        up[:, i] += h
        down[:, i] -= h
        slope = (-np.log(T.forward(up, net)[0][:, 0]) + np.log(T.forward(down, net)[0][:, 0])) / (2 * h)
        assert np.allclose(gradient[:, i], slope, atol=1e-4)


def test_attack_on_the_network(rows, trained):
    model, _ = trained
    grid = T.attack_network(rows, model, "y", ["id"], [0, 1], [-1.0, -1.0], [1.0, 1.0])
    again = T.attack_network(rows.repartition(5), model, "y", ["id"], [0, 1], [-1.0, -1.0], [1.0, 1.0])
    key = ["attack", "budget"]
    first, second = ({(r.attack, r.budget): r for r in attack_metrics(g, key).collect()} for g in (grid, again))
    assert len(first) == 6 and all(r.semantic_constraint_violations == 0 for r in first.values())
    assert all(r.attack_recall == second[k].attack_recall for k, r in first.items())
    assert first["PGD", 0.05].attack_success_rate >= first["PGD", 0.01].attack_success_rate
    assert grid.where("linf > budget * 2 + 1e-9 or (y = 0 and changed > 0)").count() == 0


def test_attack_rounds_whole_numbers_and_keeps_columns(spark):
    """Both attacks against a plain loop over rows, with one feature that is whole in raw units."""
    from flowgate.operators.robustness import PGD_STEP_FRACTION, PGD_STEPS, random_starts

    layers, rng = (2, 3, 2), np.random.default_rng(3)
    flat = rng.normal(size=2 * 3 + 3 + 3 * 2 + 2)
    net, (mean, scale) = T.layer_weights(flat, layers), (3.0, 2.0)
    df = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("s"), F.col("id") % 3).alias("seed"), F.array((F.col("id") % 7 - 3) / 2.0, (F.col("id") % 5 - 3.0) / 2.0).alias("x"))
    low, high = np.array([-1.5, -1.5]), np.array([1.5, 0.5])
    grid = T.attack_network(df, (layers, flat), "y", ["id"], [0, 1], low, high, features="x", budgets=[0.3], keep=["id", "seed"], whole={1: (mean, scale)})
    got = {(r.id, r.attack): r for r in grid.collect()}
    starts = df.select("id", "x", "y", "seed", *random_starts(["id"], T.ATTACK_SEED, ["u0", "u1"])).collect()
    assert len(got) == 120
    for r in starts:
        for attack in ("FGSM", "PGD"):
            z, e = np.array(r.x), 0.3 * (high - low)
            x, n, step = (z + (2 * np.array([r.u0, r.u1]) - 1) * e, PGD_STEPS, e * PGD_STEP_FRACTION) if attack == "PGD" else (z.copy(), 1, e)
            for _ in range(n if r.y else 0):
                x = np.clip(np.clip(x - step * np.sign(T.benign_gradient(x[None], net)[0]), z - e, z + e), low, high)
                x[1] = (np.rint(x[1] * scale + mean) - mean) / scale
            x = x if r.y else z
            out = got[r.id, attack]
            assert out.seed == r.seed and out.score == pytest.approx(T.forward(x[None], net)[0][0, 1]) and out.linf == pytest.approx(np.abs(x - z).max())


def test_audit_models(rows):
    out = {r.model: r.validation_accuracy for r in T.audit_models(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), "y", ["id"]).collect()}
    assert out["linear"] > 0.9 > out["label_shuffle_linear"] and out["dummy"] < 0.7


def test_shuffled_labels_keep_their_number(rows):
    out = T.shuffled_labels(rows, "y", ["id"])
    assert out.agg(F.sum("y")).first() == rows.agg(F.sum("y")).first()
    assert 150 < out.join(rows.select("id", F.col("y").alias("was")), "id").where("y = was").count() < 450


def test_large_vocabulary_encodes_unknown_as_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    model = preprocess.index_categories(train, ["c"], {"c": "a"})
    out = model.transform(preprocess.impute_modes(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), {"c": "a"}))
    assert [list(r.v) for r in out.select(vector_to_array("c_vector").alias("v")).collect()] == [[1, 0], [0, 1], [0, 0], [1, 0]]


def test_model_table_shares_no_vector_between_splits(spark):
    df = spark.range(4000).select((F.col("id") % 300).alias("a"), (F.col("id") % 7).cast("string").alias("b"), (F.col("id") % 300 % 2).alias("label"))
    contract = M.Contract("t", ("a",), categorical=("b",), removed=("label",), duplicate_policy=M.DUPLICATE_AWARE, max_rows=2000)
    out = M.materialize(df, contract, F.col("label").cast("int"))
    assert out.groupBy("fingerprint").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert 1900 < out.count() <= 2000
    with pytest.raises(ValueError):
        M.model_rows(df, M.Contract("t", ("a", "label"), removed=("label",)), F.col("label"))
