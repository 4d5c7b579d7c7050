"""Exact k-means over whole-number vectors; most centroid distances are ruled out by Ptolemy's inequality.

For four points the product of two opposite distances is at most the sum of the two other products. With two fixed pivots p and s it follows that

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

Pivots do not move, so a vector's distances to them are computed once and stored beside it. In each round only the centroids' distances to the
pivots are new. The bounds are evaluated in floating point with room for its error, on the safe side; centroids that a
bound cannot exclude are compared exactly, in whole numbers, nearest bound first.

Centroids are ``k`` vectors; they are all that the driver holds and all that is broadcast. A task adds up its vectors by cluster before
anything is shuffled, so a cluster with any share of the vectors sends one row per component and task.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgate.staging import stage

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
PIVOTS = 6  # fifteen pairs
SLICE = 4096  # vectors that are compared at once
SMALL = 1 << 27  # components up to here have squared distances below 2**62
LARGEST = 1 << 62  # larger components do not fit a whole number of 64 bits
ROOM = 1e-12  # relative room for rounding, a thousand times what the few operations of a bound lose


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors with ``dim`` components, none null, not finite or too large, as whole numbers floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST // scale)))
    wide = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))
    return wide.where((F.size("x") == dim) & F.forall("x", finite)).select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def seeds(vectors: DataFrame, k: int = CLUSTERS, salt: str = "2:") -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of their salted ids. Ties go by components; null ids come last."""
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; beyond 64 bits in Python's whole numbers."""
    if a.dtype != object and b.dtype != object and a.size and b.size and max(np.abs(a).max(), np.abs(b).max()) > SMALL:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=-1)


def roots(distances: np.ndarray) -> np.ndarray:
    return np.sqrt(distances.astype(np.float64))


def far_apart(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` different points: the first one, then always the one farthest from those taken."""
    taken = points[:1]
    nearest = squared(points, taken[0])
    while len(taken) < n and nearest.max() > 0:
        taken = np.concatenate([taken, points[[int(nearest.argmax())]]])
        nearest = np.minimum(nearest, squared(points, taken[-1]))
    return taken


class Frame(NamedTuple):
    """Fixed pivots and their pairs."""

    points: np.ndarray
    pairs: list[tuple[int, int, float]]

    @staticmethod
    def of(points: np.ndarray) -> Frame:
        return Frame(points, [(p, s, float(roots(squared(points[[p]], points[s]))[0])) for p, s in combinations(range(len(points)), 2)])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, pivots)"""
        return np.stack([roots(squared(x, p)) for p in self.points], axis=1)

    def bounds(self, far: np.ndarray, centroid_far: np.ndarray) -> np.ndarray:
        """(rows, centroids): squared distances that the exact ones do not fall below."""
        out = np.zeros((len(far), len(centroid_far)))
        for p, s, apart in self.pairs:
            one, other = far[:, p, None] * centroid_far[:, s], far[:, s, None] * centroid_far[:, p]
            np.maximum(out, (np.abs(one - other) - ROOM * (one + other)) / apart, out=out)
        return out * out * (1 - ROOM)


def nearest(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its nearest centroid (the smaller number on ties), the squared distance, and how many exact distances were needed in all."""
    bounds = frame.bounds(far, frame.distances(centroids))
    order = np.argsort(bounds, axis=1, kind="stable")
    rows = np.arange(len(v))
    best = order[:, 0].copy()
    least = squared(v, centroids[best])
    compared = len(v)
    for rank in range(1, len(centroids)):
        own = order[rows, rank]
        # a float of a whole number may be rounded down, hence the room
        open_ = bounds[rows, own] <= least[rows].astype(np.float64) * (1 + ROOM)
        rows = rows[open_]
        if not len(rows):
            break
        own = own[open_]
        exact = squared(v[rows], centroids[own])
        compared += len(rows)
        better = (exact < least[rows]) | ((exact == least[rows]) & (own < best[rows]))
        if exact.dtype != least.dtype:
            least = least.astype(object)
        least[rows[better]], best[rows[better]] = exact[better], own[better]
    return best, least, compared


def _matrix(column: pa.ListArray, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind, copy=False)


def with_pivots(vectors: DataFrame, frame: Frame, dim: int) -> DataFrame:
    """(vec_id, v, far): the vectors with their distances to the pivots."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                far = frame.distances(_matrix(part.column("v"), dim, np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(far), pa.list_(pa.float64()))], names=["vec_id", "v", "far"])

    return vectors.select("vec_id", "v").mapInArrow(rows, "vec_id long, v array<long>, far array<double>")


def _assign(batch: pa.RecordBatch, centroids: np.ndarray, frame: Frame):
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        v = _matrix(part.column("v"), centroids.shape[1], np.int64)
        far = _matrix(part.column("far"), len(frame.points), np.float64)
        yield part, v, *nearest(v, far, centroids, frame)


def cluster_sums(table: DataFrame, centroids: np.ndarray, frame: Frame) -> DataFrame:
    """(cluster, place, n, total): the number of vectors and the sum of each component, by nearest centroid."""
    k, dim = centroids.shape
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def rows(batches):
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=object)
        for batch in batches:
            for _, v, best, _, _ in _assign(batch, shared.value, frame):
                order = np.argsort(best, kind="stable")
                found, starts, counts = np.unique(best[order], return_index=True, return_counts=True)
                n[found] += counts
                if np.abs(v).max() > SMALL:
                    v = v.astype(object)
                total[found] += np.add.reduceat(v[order], starts, axis=0)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(found, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(found))), pa.array(np.repeat(n[found], dim)),
             pa.array([str(x) for x in total[found].ravel().tolist()], pa.string())], names=["cluster", "place", "n", "total"],
        )

    parts = table.mapInArrow(rows, "cluster int, place int, n long, total string")
    return parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid with vectors at the floor of their mean; the others where they are. Reads k * dim rows."""
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


class Clustering(NamedTuple):
    """Final centroids, and (vec_id, cluster, distance) of every kept vector as a written table."""

    centroids: np.ndarray
    assigned: DataFrame


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS,
) -> Clustering:
    """Lloyd's rounds from ``k`` hashed seeds, then one more assignment. All distances, means and ties are exact.

    Vectors of another length or with a null, NaN, infinite or enormous component (2**62 after scaling) take no part. Fewer vectors than ``k``
    make as many centroids; none give no rows. Equal vectors, repeated rows and repeated ids are rows like any others; a null id stays null and
    is a seed only if too few others exist. A squared distance above 64 bits is null. Other columns are ignored, whatever their names.
    """
    vectors = kept_vectors(df, id_col, vector_col, dim, scale)
    centroids = np.array(seeds(vectors, k), dtype=np.int64).reshape(-1, dim)
    if not len(centroids):
        return Clustering(centroids, vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"))
    frame = Frame.of(far_apart(centroids, pivots))
    table = stage(with_pivots(vectors, frame, dim))
    for _ in range(rounds):
        centroids = moved(cluster_sums(table, centroids, frame), centroids)
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def rows(batches):
        for batch in batches:
            for part, _, best, least, _ in _assign(batch, shared.value, frame):
                if least.dtype == object:
                    least = [x if x < 1 << 63 else None for x in least.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    return Clustering(centroids, stage(table.mapInArrow(rows, "vec_id long, cluster int, distance long")))


def inertia(result: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector; sums above 64 bits are null."""
    assigned = result.assigned
    known = F.sum(F.coalesce(F.col("distance").cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")))  # null: above 64 bits, and so is the sum
    sums = assigned.groupBy("cluster").agg(known.alias("s")).collect()  # one row per cluster
    whole = sum(r.s for r in sums)
    fits = lambda x: int(x) if x < 1 << 63 else None
    schema = T.StructType.fromDDL("of int, cluster_inertia long, inertia long, centroid_sha256 string")
    about = assigned.sparkSession.createDataFrame([(r.cluster, fits(r.s), fits(whole), digest(result.centroids[r.cluster])) for r in sums], schema)
    return assigned.join(F.broadcast(about), F.col("cluster") == F.col("of")).drop("of")
