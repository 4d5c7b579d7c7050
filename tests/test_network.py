"""The specified network: gradients, dropout, one step, data-parallel training, and going on after a break."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowgate.operators import model as T
from flowgate.operators import network as N
from flowgate.staging import stage, stage_path


@pytest.fixture(scope="module")
def rows(spark):
    x = [(F.abs(F.xxhash64("id", F.lit(i))) % 1000 / 500.0 - 1.0) for i in range(3)]
    df = spark.range(900).select("id", F.array(*x).alias("a"))
    return stage(df.select("id", (F.col("a")[0] * F.col("a")[1] > 0).cast("int").alias("y"), array_to_vector("a").alias("features"), F.col("a").alias("plain")))


def test_gradient_equals_differences():
    r = np.random.default_rng(1)
    network = N.initial((3, 5, 4, 2), 7)
    x, y = r.normal(size=(20, 3)), r.integers(0, 2, size=20)
    masks = [N.kept_units(np.arange(20), 2, k, w, 0.4) for k, w in enumerate((5, 4))]
    for m in ((), masks):
        loss, gradient = N.loss_and_gradient(x, y, network.layers(), m)
        for i in range(len(network.flat)):
            moved = []
            for h in (1e-6, -1e-6):
                flat = network.flat.copy()
                flat[i] += h
                moved.append(N.loss_and_gradient(x, y, N.Network(network.widths, flat).layers(), m)[0])
            assert gradient[i] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-4)
        assert loss == pytest.approx(N.losses(N.logits(x, network.layers(), m)[0], y).sum())


def test_dropout_depends_on_row_epoch_and_unit_only():
    h = np.arange(-2000, 2000)
    one = N.kept_units(h, 1, 0, 50, 0.2)
    assert 0.78 < (one > 0).mean() < 0.82 and set(np.unique(one)) == {0.0, 1.25}
    order = np.random.default_rng(0).permutation(len(h))
    assert (N.kept_units(h[order], 1, 0, 50, 0.2) == one[order]).all()
    for other in (N.kept_units(h, 2, 0, 50, 0.2), N.kept_units(h, 1, 1, 50, 0.2)):
        assert 0.6 < (other == one).mean() < 0.76


@pytest.mark.parametrize("direct", [N.DIRECT, 1])
def test_gradients_of_tasks_add_up(rows, direct, monkeypatch):
    monkeypatch.setattr(N, "DIRECT", direct)
    network = N.initial((3, 6, 2), 3)
    plain = rows.select(F.col("plain").alias("x"), "y", F.col("id").alias("h"))
    found = plain.collect()
    x, y, h = (np.array([r[i] for r in found]) for i in range(3))
    masks = [N.kept_units(h, 4, 0, 6, 0.2)]
    loss, gradient = N.loss_and_gradient(x, y, network.layers(), masks)
    n, mean, towards = N.mean_gradient(plain.repartition(7), network, 4, 0.2)
    assert n == len(x) and mean == pytest.approx(loss / n) and np.allclose(towards, gradient / n)
    assert N.mean_loss(plain, network) == pytest.approx(N.losses(N.logits(x, network.layers())[0], y).mean())
    assert N.mean_gradient(plain.limit(0), network)[0] == 0


def test_adam_against_its_definition():
    flat, g = np.array([1.0, -2.0]), np.array([30.0, 40.0])
    adam, first, second = N.Adam(0, np.zeros(2), np.zeros(2)), np.zeros(2), np.zeros(2)
    wanted = flat.copy()
    for t in range(1, 4):
        flat, adam = adam.apply(flat, g * t, rate=0.1)
        cut = g * t * 5 / (50 * t + 1e-6)
        first, second = 0.9 * first + 0.1 * cut, 0.999 * second + 0.001 * cut**2
        wanted = wanted - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(flat, wanted) and adam.step == t


SETTINGS = dict(hidden=(16, 8), batch=100, rate=0.02)


def test_training_goes_on_after_a_break(spark, rows):
    """The same weights and losses as without a break, an unfinished epoch ignored; columns and partitions do not matter."""
    learn, held = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    whole, curve = N.train(learn, held, "y", ["id"], max_epochs=5, **SETTINGS)
    store = stage_path(spark, "broken")
    N.train(learn, held, "y", ["id"], max_epochs=2, store=store, **SETTINGS)
    spark.range(1).write.parquet(f"{store}/at-000003")
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{store}/at-000003/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert N.history(spark, store).count() == 2
    again, resumed = N.train(learn.repartition(5), held.repartition(3), "y", ["id"], max_epochs=5, store=store, **SETTINGS)
    a, b = ([tuple(r) for r in c.orderBy("epoch").collect()] for c in (curve, resumed))
    assert [r[0] for r in a] == [1, 2, 3, 4, 5] and np.allclose(a, b) and np.allclose(whole.flat, again.flat)
    assert np.allclose(N.best(spark, store).flat, whole.flat)
    assert min(r[2] for r in b) == pytest.approx(N.mean_loss(held.select(F.col("plain").alias("x"), "y"), whole))


def test_training_learns_and_stops(rows):
    learn, held = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    network, curve = N.train(learn, held, "y", ["id"], max_epochs=12, features="plain", **SETTINGS)
    out = N.score(network, rows, ["id", "y"], features="plain")
    assert out.columns == ["id", "y", "score", "pred"] and out.where("pred = y").count() > 780
    found = curve.orderBy("epoch").collect()
    assert found[-1].train_loss < found[0].train_loss
    _, short = N.train(learn, held, "y", ["id"], patience=1, max_epochs=9, rate=0.0, hidden=(4,), batch=1000)
    assert short.count() == 2
    with pytest.raises(ValueError):
        N.train(learn.limit(0), held, "y", ["id"])


def test_attack_on_the_rectified_network(rows):
    network = N.initial((3, 6, 4, 2), 5)
    net, low, high = network.layers(), np.full(3, -1.0), np.full(3, 1.0)
    grid = T.attack_network(rows, network, "y", ["id"], [0, 1, 2], low, high, attacks=["FGSM"], budgets=[0.1], keep=["id"])
    got = {r.id: r for r in grid.collect()}
    for r in rows.collect():
        x = np.array([r.plain])
        p, h = N.softmax(N.logits(x, net)[0]), 1e-6
        assert got[r.id].clean_score == pytest.approx(p[0, 1])
        if r.y:
            slope = np.array([N.losses(N.logits(x + h * np.eye(3)[i], net)[0], [0])[0] - N.losses(N.logits(x - h * np.eye(3)[i], net)[0], [0])[0] for i in range(3)]) / (2 * h)
            if (np.abs(slope) > 1e-4).all():
                moved = np.clip(x - 0.2 * np.sign(slope), -1, 1)
                assert got[r.id].score == pytest.approx(N.softmax(N.logits(moved, net)[0])[0, 1], abs=1e-6)


def test_small_batches_share_a_job(spark, rows, monkeypatch):
    """The same weights and losses as with a job for each step, and fewer jobs than steps."""
    learn, held, jobs, found = rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), [], []
    for together in (N.TASK_ROWS, 1):
        monkeypatch.setattr(N, "TASK_ROWS", together)
        spark.sparkContext.setJobGroup(f"steps {together}", "training")
        network, curve = N.train(learn, held, "y", ["id"], max_epochs=2, hidden=(8,), batch=40, rate=0.02)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps {together}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        found.append((network.flat, [tuple(r) for r in curve.orderBy("epoch").collect()]))
    assert jobs[0] < 30 <= jobs[1]
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1])
