"""The binary network as specified: rectified hidden units with dropout, cross entropy, Adam with cut gradients, early stopping.

Training is synchronous and data-parallel. The rows are dealt once into fixed mini-batches by a hash of their keys and written by batch, so a step
reads its own rows only. Each task computes the summed gradient of its rows in Arrow batches; sums of many tasks are added up in two levels, and the driver
holds weights and gradients, never rows. Batches that are too small to be shared by tasks are not given a job each: a task makes the steps of some of
them, one after the other in the epoch's order, up to ``TASK_ROWS`` rows, and hands the weights back. Dropout masks are a function of row key, epoch and unit. So results do not depend on the
partitioning, up to the last bits of floating-point sums.

Every epoch ends with a row in a store below a folder: losses, weights and the optimizer's state. The best model is read from there, and a training
that was broken off goes on after its last whole epoch as if nothing had happened.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgate.functions.columns import named
from flowgate.operators.metrics import predicted
from flowgate.operators.robustness import THRESHOLD
from flowgate.staging import stage_path

# Shape, optimizer and stopping rule of the classifier.
HIDDEN = (128, 64)
DROPOUT = 0.2
RATE = 0.001
BATCH = 4096
MAX_EPOCHS = 15
PATIENCE = 3
MAX_NORM = 5.0
DECAY1, DECAY2, EPSILON = 0.9, 0.999, 1e-8

MAX_STEPS = 1000  # batches of an epoch; with more rows than MAX_STEPS * BATCH the batches grow
TASK_ROWS = 65_536  # rows of the small batches whose steps one task makes
DIRECT = 32  # partial gradients that are added up on the driver; more of them are first added up by tasks
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

# Tasks carry the numpy helpers of this module with them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Network(NamedTuple):
    """Layer widths and all weights, layer by layer: the matrix (inputs by outputs) row by row, then the bias."""

    widths: tuple[int, ...]
    flat: np.ndarray

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for n, m in zip(self.widths, self.widths[1:]):
            out.append((self.flat[at : at + n * m].reshape(n, m), self.flat[at + n * m : at + n * m + m]))
            at += n * m + m
        return out


def initial(widths: Sequence[int], seed: int) -> Network:
    """Weights and biases uniform between plus and minus one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    return Network(tuple(widths), np.concatenate([rng.uniform(-1, 1, size=(n + 1) * m) / sqrt(n) for n, m in zip(widths, widths[1:])]))


def kept_units(hashes: np.ndarray, epoch: int, layer: int, width: int, dropout: float) -> np.ndarray:
    """(rows, width): 0 where a unit is dropped, else the factor that makes up for it."""
    with np.errstate(over="ignore"):
        place = np.uint64(epoch * 1_000_003 + layer) * np.uint64(_MIX[1]) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_MIX[0])
        z = hashes.astype(np.int64).view(np.uint64)[:, None] ^ place
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
    return ((z >> np.uint64(11)).astype(np.float64) / (1 << 53) >= dropout) / (1.0 - dropout)


def logits(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]], masks: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outputs before the softmax, and the hidden units."""
    hidden = []
    for k, (matrix, bias) in enumerate(net[:-1]):
        x = np.maximum(x @ matrix + bias, 0.0)
        if masks:
            x = x * masks[k]
        hidden.append(x)
    return x @ net[-1][0] + net[-1][1], hidden


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross entropy of each row."""
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(y)), y]


def loss_and_gradient(x: np.ndarray, y: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]], masks: Sequence[np.ndarray] = ()) -> tuple[float, np.ndarray]:
    """Summed over the rows; the gradient in the layout of ``Network.flat``."""
    z, hidden = logits(x, net, masks)
    back = softmax(z)
    back[np.arange(len(y)), y] -= 1.0
    parts = []
    for k in range(len(net) - 1, -1, -1):
        below = hidden[k - 1] if k else x
        parts += [back.sum(axis=0), (below.T @ back).ravel()]
        if k:
            back = (back @ net[k][0].T) * (below > 0)
            if masks:
                back = back * masks[k - 1]
    return float(losses(z, y).sum()), np.concatenate(parts[::-1])


def _features(df: DataFrame, features: str) -> Column:
    return F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


_PART = "part int, n long, loss double, gradient array<double>"


def _parts_of(part: int, n: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([loss], pa.float64()), pa.array([gradient], pa.list_(pa.float64()))], names=["part", "n", "loss", "gradient"]
    )


def _added(batches):
    """Partial sums in the order of their parts."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
    if rows:
        yield _parts_of(rows[0]["part"], sum(r["n"] for r in rows), sum(r["loss"] for r in rows), np.sum([r["gradient"] for r in rows], axis=0))


def mean_gradient(rows: DataFrame, network: Network, epoch: int = 0, dropout: float = 0.0) -> tuple[int, float, np.ndarray]:
    """Number of rows (x, y, h), mean loss and mean gradient; a sum per task, added up by tasks if they are many."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def sums(batches):
        net, widths = shared.value.layers(), shared.value.widths
        n, loss, gradient, part = 0, 0.0, np.zeros(len(shared.value.flat)), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                h = batch.column("h").to_numpy()
                masks = [kept_units(h, epoch, k, w, dropout) for k, w in enumerate(widths[1:-1])] if dropout else ()
                one, towards = loss_and_gradient(_matrix(batch, widths[0]), batch.column("y").to_numpy(), net, masks)
                n, loss, gradient = n + batch.num_rows, loss + one, gradient + towards
        if n:
            yield _parts_of(part, n, loss, gradient)

    parts = rows.withColumn("part", F.spark_partition_id()).mapInArrow(sums, _PART)
    tasks = rows.rdd.getNumPartitions()
    if tasks > DIRECT:
        parts = parts.repartitionByRange(ceil(sqrt(tasks)), "part").mapInArrow(_added, _PART)
    total = next(_added(parts.toArrow().to_batches()), None)
    shared.destroy()
    if total is None:
        return 0, 0.0, np.zeros(len(network.flat))
    n = total.column("n")[0].as_py()
    return n, total.column("loss")[0].as_py() / n, np.array(total.column("gradient")[0].as_py()) / n


def mean_loss(rows: DataFrame, network: Network) -> float:
    """Mean cross entropy of rows (x, y) without dropout."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def sums(batches):
        net, n, loss = shared.value.layers(), 0, 0.0
        for batch in batches:
            if batch.num_rows:
                loss += float(losses(logits(_matrix(batch, shared.value.widths[0]), net)[0], batch.column("y").to_numpy()).sum())
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss], pa.float64())], names=["n", "loss"])

    found = rows.select("x", "y").mapInArrow(sums, "n long, loss double").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
    return found["loss"] / found["n"] if found["n"] else 0.0


class Adam(NamedTuple):
    """State of the optimizer: steps made, means of gradients and of their squares."""

    step: int
    first: np.ndarray
    second: np.ndarray

    def apply(self, flat: np.ndarray, gradient: np.ndarray, rate: float = RATE, max_norm: float = MAX_NORM) -> tuple[np.ndarray, Adam]:
        """The weights after one more step, the gradient first cut to the given norm."""
        norm = float(np.sqrt((gradient**2).sum()))
        gradient = gradient * min(1.0, max_norm / (norm + 1e-6))
        step = self.step + 1
        first, second = DECAY1 * self.first + (1 - DECAY1) * gradient, DECAY2 * self.second + (1 - DECAY2) * gradient**2
        return flat - rate * (first / (1 - DECAY1**step)) / (np.sqrt(second / (1 - DECAY2**step)) + EPSILON), Adam(step, first, second)


_MADE = "steps long, losses array<double>, weights array<double>, first array<double>, second array<double>"


def small_steps(rows: DataFrame, order: Sequence[int], network: Network, adam: Adam, epoch: int, dropout: float, rate: float) -> tuple[list[float], Network, Adam]:
    """The steps of some small batches of rows (x, y, h, batch) in the given order, made by one task: mean losses, network and optimizer after them.

    The task holds the sums of one batch and a piece of its rows. A batch without rows is no step.
    """
    shared = rows.sparkSession.sparkContext.broadcast((*network, *adam))

    def run(batches):
        widths, flat, *moments = shared.value
        net, state = Network(widths, flat), Adam(*moments)
        found, at, n, loss, gradient = [], None, 0, 0.0, np.zeros(len(net.flat))

        def step():
            nonlocal net, state
            flat, state = state.apply(net.flat, gradient / n, rate)
            net = Network(net.widths, flat)
            found.append(loss / n)

        for piece in batches:
            places = piece.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if places[begin] != at:
                    if n:
                        step()
                    at, n, loss, gradient = places[begin], 0, 0.0, np.zeros(len(net.flat))
                part = piece.slice(begin, end - begin)
                h = part.column("h").to_numpy()
                masks = [kept_units(h, epoch, k, w, dropout) for k, w in enumerate(net.widths[1:-1])] if dropout else ()
                one, towards = loss_and_gradient(_matrix(part, net.widths[0]), part.column("y").to_numpy(), net.layers(), masks)
                n, loss, gradient = n + len(part), loss + one, gradient + towards
        if n:
            step()
        arrays = [pa.array([state.step], pa.int64()), *(pa.array([list(x)], pa.list_(pa.float64())) for x in (found, net.flat, state.first, state.second))]
        yield pa.RecordBatch.from_arrays(arrays, names=["steps", "losses", "weights", "first", "second"])

    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("batch")).alias("place")
    chosen = rows.where(F.col("batch").isin(list(order))).select("x", "y", "h", place).coalesce(1).sortWithinPartitions("place", "h")
    made = chosen.mapInArrow(run, _MADE).first()
    shared.destroy()
    if made is None:
        return [], network, adam
    return list(made.losses), Network(network.widths, np.array(made.weights)), Adam(made.steps, np.array(made["first"]), np.array(made["second"]))


# ---------------------------------------------------------------- the store of epochs

_EPOCH = "epoch int, train_loss double, validation_loss double, bad int, step long, widths array<int>, weights array<double>, first array<double>, second array<double>"


def _whole_epochs(spark: SparkSession, store: str) -> list[str]:
    """Folders of finished epochs. One counts if Spark's success mark, which is written last, is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(store)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(top))
    return [f"{store}/{n}" for n in names if n.startswith("at-") and system.exists(hadoop.Path(f"{store}/{n}/_SUCCESS"))]


def epochs(spark: SparkSession, store: str) -> DataFrame:
    """All finished epochs of a store, weights included."""
    found = _whole_epochs(spark, store)
    return spark.read.schema(_EPOCH).parquet(*found) if found else spark.createDataFrame([], _EPOCH)


def best(spark: SparkSession, store: str) -> Network:
    """The network of the epoch with the lowest validation loss, the first one of equals."""
    row = epochs(spark, store).orderBy("validation_loss", "epoch").select("widths", "weights").first()
    if row is None:
        raise ValueError(f"no finished epoch below {store}")
    return Network(tuple(row.widths), np.array(row.weights))


def history(spark: SparkSession, store: str) -> DataFrame:
    return epochs(spark, store).select("epoch", "train_loss", "validation_loss")


def train(
    train_rows: DataFrame, validation: DataFrame, label: str, key: Sequence[str], features: str = "features", seed: int = 42, hidden: Sequence[int] = HIDDEN,
    dropout: float = DROPOUT, rate: float = RATE, batch: int = BATCH, max_epochs: int = MAX_EPOCHS, patience: int = PATIENCE, max_steps: int = MAX_STEPS, store: str | None = None,
) -> tuple[Network, DataFrame]:
    """The network with the lowest validation loss, and the losses by epoch (train: mean over its steps, with dropout).

    ``store`` is the folder of epochs; one that holds some is gone on with, which needs the same rows and settings. Rows need features of one
    length without nulls and a label of 0 or 1. Training without rows raises.
    """
    spark = train_rows.sparkSession
    store = (store or stage_path(spark, "epochs")).rstrip("/")
    plain = lambda df: df.select(_features(df, features).alias("x"), named(label).cast("int").alias("y"), F.xxhash64(*[named(k) for k in key], F.lit(seed)).alias("h"))
    n = train_rows.count()
    if not n:
        raise ValueError("no rows to train on")
    steps = min(max(1, ceil(n / batch)), max_steps)
    together = min(steps, max(1, TASK_ROWS * steps // n))
    path = stage_path(spark, "batches")
    plain(train_rows).withColumn("batch", F.pmod(F.xxhash64("h", F.lit("batch")), F.lit(steps)).cast("int")).repartition("batch").write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("x array<double>, y int, h long, batch int").parquet(path)
    seen = stage_path(spark, "validation")
    plain(validation).write.parquet(seen)
    held = spark.read.parquet(seen)

    last = epochs(spark, store).orderBy(F.desc("epoch")).first()
    if last is None:
        network = initial([len(rows.select("x").first().x), *hidden, 2], seed)
        adam, done, bad = Adam(0, np.zeros(len(network.flat)), np.zeros(len(network.flat))), 0, 0
    else:
        network = Network(tuple(last.widths), np.array(last.weights))
        adam, done, bad = Adam(last.step, np.array(last["first"]), np.array(last["second"])), last.epoch, last.bad
    lowest = min([r.validation_loss for r in history(spark, store).collect()], default=float("inf"))

    for epoch in range(done + 1, max_epochs + 1):
        if bad >= patience:
            break
        found = []
        order = np.random.default_rng([seed, epoch]).permutation(steps).tolist()
        for begin in range(0, steps, together):
            if together > 1:
                some, network, adam = small_steps(rows, order[begin : begin + together], network, adam, epoch, dropout, rate)
                found += some
                continue
            size, loss, gradient = mean_gradient(rows.where(F.col("batch") == order[begin]).drop("batch"), network, epoch, dropout)
            if size:
                flat, adam = adam.apply(network.flat, gradient, rate)
                network = Network(network.widths, flat)
                found.append(loss)
        loss = mean_loss(held, network)
        lowest, bad = (loss, 0) if loss < lowest else (lowest, bad + 1)
        row = (epoch, float(np.mean(found)), loss, bad, adam.step, list(network.widths), network.flat.tolist(), adam.first.tolist(), adam.second.tolist())
        spark.createDataFrame([row], _EPOCH).coalesce(1).write.mode("overwrite").parquet(f"{store}/at-{epoch:06d}")
    return best(spark, store), history(spark, store)


def score(network: Network, df: DataFrame, keep: Sequence[str], features: str = "features", threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns with the score P(class 1) and the prediction score >= threshold."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    rows = df.select(*[named(k) for k in keep], _features(df, features).alias("x"))
    names = rows.columns[:-1]

    def run(batches):
        net, width = shared.value.layers(), shared.value.widths[0]
        for batch in batches:
            p = softmax(logits(_matrix(batch, width), net)[0])[:, 1] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(p, pa.float64())], names=[*names, "score"])

    out = rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1] + [T.StructField("score", T.DoubleType())]))
    return out.withColumn("pred", predicted(F.col("score"), threshold))
