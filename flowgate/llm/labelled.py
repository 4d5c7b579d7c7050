"""Bounded samples of labelled documents, and a two-parameter calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgate.staging import stage


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents as (doc_id, text, label), those with the smallest hashes of their ids.

    Only the chosen ids, of which there are ``rows`` at most, are sent to all tasks. Ids with two different labels and null labels take no part.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    if where is not None:
        marked = marked.where(where)
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(texts.join(F.broadcast(chosen), texts.doc_id == chosen.id).select("doc_id", "text", "label"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(score: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns scores into probabilities of label 1 (Newton steps)."""
    center, scale = (float(np.average(score, weights=weight)), float(score.std()) or 1.0) if len(score) else (0.0, 1.0)
    x = np.stack([(score - center) / scale, np.ones(len(score))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = logistic(x @ beta)
        gradient = x.T @ (weight * (p - label)) + ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta -= move * min(1.0, 4 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * center / scale)
