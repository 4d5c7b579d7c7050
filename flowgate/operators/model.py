"""Training, scoring and attacking a binary neural network, and simple audit models."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgate.functions.columns import named
from flowgate.functions.keys import order_key
from flowgate.operators.cuts import find_cuts, segment, totals
from flowgate.operators.metrics import predicted
from flowgate.operators.network import Network
from flowgate.operators.robustness import ATTACKS, ATTACK_SEED, BUDGETS, PGD_STEPS, PGD_STEP_FRACTION, THRESHOLD, random_starts

# Shape and stopping rule of the classifier.
HIDDEN = (128, 64)
BATCH = 4096
MAX_EPOCHS = 15
PATIENCE = 3
# Optimizer iterations between two looks at the validation loss.
ITERATIONS_PER_EPOCH = 10

# Tasks carry the numpy helpers of this module with them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score(model, df: DataFrame, keep: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns with the score P(class 1) and the prediction score >= threshold."""
    out = model.transform(df).select(*[named(k) for k in keep], vector_to_array("probability")[1].alias("score"))
    return out.withColumn("pred", predicted(F.col("score"), threshold))


def log_loss(model, df: DataFrame, label: str) -> float:
    p = vector_to_array("probability")
    chosen = F.greatest(F.when(named(label) == 1, p[1]).otherwise(p[0]), F.lit(1e-15))
    return model.transform(df).agg(F.avg(-F.log(chosen)).alias("loss")).first().loss


def train(
    train_rows: DataFrame, validation: DataFrame, label: str, features: str = "features", seed: int = 42, hidden: Sequence[int] = HIDDEN,
    max_epochs: int = MAX_EPOCHS, patience: int = PATIENCE, iterations: int = ITERATIONS_PER_EPOCH,
) -> tuple[MultilayerPerceptronClassificationModel, DataFrame]:
    """The network with the lowest validation loss, and the loss history.

    Training proceeds in epochs of a few optimizer iterations, each one starting from the weights of the
    last; it stops when the validation loss has not improved for ``patience`` epochs. Both inputs are read
    once per epoch, so pass staged tables.
    """
    width = len(train_rows.select(features).first()[0])
    best, best_loss, bad, history, weights = None, float("inf"), 0, [], None
    for epoch in range(1, max_epochs + 1):
        trainer = MultilayerPerceptronClassifier(
            layers=[width, *hidden, 2], seed=seed, maxIter=iterations, blockSize=BATCH, featuresCol=features, labelCol=label
        )
        if weights is not None:
            trainer = trainer.setInitialWeights(weights)
        model = trainer.fit(train_rows)
        weights = model.weights
        loss = log_loss(model, validation, label)
        history.append((epoch, log_loss(model, train_rows, label), loss))
        if loss < best_loss:
            best, best_loss, bad = model, loss, 0
        else:
            bad += 1
        if bad >= patience:
            break
    listed = train_rows.sparkSession.createDataFrame(history, "epoch int, train_loss double, validation_loss double")
    return best, listed


# ---------------------------------------------------------------- audit models

def shuffled_labels(df: DataFrame, label: str, key: Sequence[str], seed: object = 42) -> DataFrame:
    """The same number of ones, handed to rows that a hash order picks: a random permutation of the label."""
    ones = totals(df, label).get(1, 0)
    tagged = df.withColumns({"_all": F.lit(0), "_k": order_key(key, seed)})
    cuts = find_cuts(tagged, {(0, 0): float(ones)}, "_all", "_k")
    chosen = segment(cuts, F.col("_all"), F.col("_k"), [0], 1) == 0
    return tagged.withColumn(label, chosen.cast(df.schema[label].dataType)).drop("_all", "_k")


def audit_models(train_rows: DataFrame, validation: DataFrame, label: str, key: Sequence[str], features: str = "features", seed: int = 42) -> DataFrame:
    """Validation accuracy of a prior-only, a linear and a shallow tree model, and of a linear model on shuffled labels."""
    spark = train_rows.sparkSession
    rows = totals(train_rows, label)
    prior = max(sorted(rows), key=lambda c: rows[c])

    def accuracy(predicted: DataFrame, column: str) -> float:
        return predicted.agg(F.avg((F.col(column) == named(label)).cast("double")).alias("a")).first().a

    # Unit penalty on the summed loss.
    linear = LogisticRegression(
        maxIter=100, regParam=1.0 / sum(rows.values()), standardization=False, featuresCol=features, labelCol=label
    )
    tree = DecisionTreeClassifier(maxDepth=3, seed=seed, featuresCol=features, labelCol=label)
    found = [
        ("dummy", accuracy(validation.withColumn("_p", F.lit(prior)), "_p")),
        ("linear", accuracy(linear.fit(train_rows).transform(validation), "prediction")),
        ("shallow_tree", accuracy(tree.fit(train_rows).transform(validation), "prediction")),
        (
            "label_shuffle_linear",
            accuracy(linear.fit(shuffled_labels(train_rows, label, key, seed)).transform(validation), "prediction"),
        ),
    ]
    return spark.createDataFrame(found, "model string, validation_accuracy double")


# ---------------------------------------------------------------- attacks on the network

def layer_weights(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The flat weight vector as (matrix, bias) per layer."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        matrix = weights[at: at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        out.append((matrix, weights[at: at + n_out]))
        at += n_out
    return out


def forward(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]], rectified: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class probabilities and hidden activations: sigmoid or rectified units, softmax output."""
    hidden = []
    for matrix, bias in net[:-1]:
        x = x @ matrix + bias
        x = np.maximum(x, 0.0) if rectified else 1.0 / (1.0 + np.exp(-x))
        hidden.append(x)
    logits = x @ net[-1][0] + net[-1][1]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), hidden


def benign_gradient(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]], rectified: bool = False) -> np.ndarray:
    """Gradient, by input, of the cross entropy towards class 0."""
    p, hidden = forward(x, net, rectified)
    back = p.copy()
    back[:, 0] -= 1.0
    for (matrix, _), h in zip(reversed(net[1:]), reversed(hidden)):
        back = (back @ matrix.T) * ((h > 0) if rectified else h * (1.0 - h))
    return back @ net[0][0].T


def attack_network(
    df: DataFrame, model: Network | MultilayerPerceptronClassificationModel | tuple[Sequence[int], Sequence[float]], y: str, key: Sequence[str],
    attackable: Sequence[int], low: Sequence[float], high: Sequence[float], features: str = "features", attacks: Sequence[str] = ATTACKS,
    budgets: Sequence[float] = BUDGETS, seed: object = ATTACK_SEED, threshold: float = THRESHOLD, keep: Sequence[str] = (),
    whole: Mapping[int, tuple[float, float]] | None = None,
) -> DataFrame:
    """The attack grid against the network, in the layout of ``robustness.attack_grid``: ``keep`` columns and the results.

    ``model`` is a trained network, with rectified or sigmoid units, or the layer sizes and flat weights of one with sigmoid units. ``attackable`` are feature positions, ``low`` and
    ``high`` their training range in model units. ``whole`` gives mean and scale of the features that are whole numbers in raw
    units; they are rounded there after each step. The gradient of a network has no column expression, so batches of
    rows go through numpy; rows stay where they are and random starts come from row keys.
    """
    rectified = isinstance(model, Network)
    layers, flat = (list(model[0]), np.array(model[1], dtype=float)) if isinstance(model, tuple) else (list(model.getLayers()), model.weights.toArray())
    shared = df.sparkSession.sparkContext.broadcast(flat)
    idx, lo, hi = np.array(attackable), np.array(low, dtype=float), np.array(high, dtype=float)
    rounded = [(i, *whole[p]) for i, p in enumerate(attackable) if whole and p in whole]
    conditions = [(a, float(b)) for a in attacks for b in budgets]

    def perturb(z: np.ndarray, start: np.ndarray, attack: str, budget: float, net) -> np.ndarray:
        epsilon = budget * (hi - lo)
        origin, x = z[:, idx], z.copy()
        if attack == "PGD":
            x[:, idx] += (2.0 * start - 1.0) * epsilon
        steps, length = (PGD_STEPS, epsilon * PGD_STEP_FRACTION) if attack == "PGD" else (1, epsilon)
        for _ in range(steps):
            moved = x[:, idx] - length * np.sign(benign_gradient(x, net, rectified)[:, idx])
            moved = np.clip(moved, origin - epsilon, origin + epsilon)
            moved = np.maximum(np.minimum(moved, hi), lo)
            for i, mean, scale in rounded:
                moved[:, i] = (np.rint(moved[:, i] * scale + mean) - mean) / scale
            x[:, idx] = moved
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = layer_weights(shared.value, layers)
        for batch in batches:
            if not len(batch):
                continue
            z, start = np.stack(batch["_x"].to_numpy()), np.stack(batch["_u"].to_numpy())
            hit = (batch["_y"] == 1).to_numpy()
            clean = forward(z, net, rectified)[0][:, 1]
            for attack, budget in conditions:
                x = z.copy()
                if hit.any():
                    x[hit] = perturb(z[hit], start[hit], attack, budget, net)
                delta = np.abs(x[:, idx] - z[:, idx])
                outside = ((x[:, idx] > hi + 1e-9) | (x[:, idx] < lo - 1e-9)).sum(axis=1)
                yield pd.concat([batch[list(keep)], pd.DataFrame(
                    {
                        "y": batch["_y"], "attack": attack, "budget": budget, "clean_score": clean, "score": forward(x, net, rectified)[0][:, 1],
                        "linf": delta.max(axis=1), "l2": np.sqrt((delta**2).sum(axis=1)), "changed": (delta > 0).sum(axis=1),
                        "violations": np.where(hit, outside, 0),
                    },
                    index=batch.index,
                )], axis=1)

    names = [f"u{i}" for i in attackable]
    starts = F.array(*(random_starts(key, seed, names) if "PGD" in attacks else [F.lit(0.5) for _ in names]))
    x = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)
    rows = df.select(*[named(k) for k in keep], named(y).cast("int").alias("_y"), x.alias("_x"), starts.alias("_u"))
    results = T.DataType.fromDDL("y int, attack string, budget double, clean_score double, score double, linf double, l2 double, changed bigint, violations bigint")
    out = rows.mapInPandas(run, T.StructType([df.schema[k] for k in keep] + results.fields))
    return out.withColumns(
        {"clean_pred": predicted(F.col("clean_score"), threshold), "pred": predicted(F.col("score"), threshold)}
    )
