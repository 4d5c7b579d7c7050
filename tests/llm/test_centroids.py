"""Exact k-means against plain whole-number arithmetic, and the bounds against exact distances."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowgate.llm import centroids as C


def plain(rows, dim=64, k=40, rounds=5, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in ranked[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for last in range(rounds + 1):
        placed = [min((apart(v, c), n) for n, c in enumerate(centers)) for _, v in kept]
        if last == rounds:
            break
        for n in range(len(centers)):
            own = [v for (_, v), (_, m) in zip(kept, placed) if m == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    sums = Counter()
    for d, n in placed:
        sums[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, n, d, sums[n], sum(sums.values()), digest[n]) for (i, _), (d, n) in zip(kept, placed))


def result(df, **settings):
    return Counter(tuple(r) for r in C.inertia(C.cluster(df, **settings)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_small_vectors(spark):
    r = random.Random(5)
    rows = [(i, [float(r.choice([0, 0, 1, -1, 2.5])) / 256 for _ in range(3)]) for i in range(400)]
    rows += [(i, [r.gauss(k, 0.05), r.gauss(-k, 0.05), r.gauss(0, 0.05)]) for i, k in enumerate([0, 1, 2, 3] * 60, 500)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (9001, None), (9002, [1.0, 2.0]), (9003, [1.0, None, 2.0]), (9004, [1.0, math.nan, 2.0]), (9005, [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string, far int").repartition(5)
    for k in (1, 7, 40, 1000):
        assert result(df, dim=3, k=k, rounds=3) == plain(rows, 3, k, 3)
    assert result(df.limit(0), dim=3) == Counter()
    assert result(df.where("vec_id = 9002"), dim=3) == Counter()


def test_large_and_equal_vectors(spark):
    rows = [(i, [float(i) * 1e6, -3e7 * (i % 7), 5.0]) for i in range(60)] + [(100 + i, [4e9, 1.0, 2.0 ** 30]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fits = lambda x: x if x < 1 << 63 else None
    wanted = Counter()
    for (i, n, d, s, t, h), m in plain(rows, 3, 4, 2).items():
        wanted[i, n, fits(d), fits(s), fits(t), h] += m
    assert result(df, dim=3, k=4, rounds=2) == wanted and any(x[2] is None for x in wanted)
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(30)], "vec_id long, embedding array<float>")
    assert result(same, dim=2, k=5) == plain([(i, [0.5, 0.25]) for i in range(30)], 2, 5)


def test_bounds_never_exceed_distances_and_spare_most(spark, sf):
    r = np.random.default_rng(3)
    for scale in (3, 1000, C.SMALL):
        x, c = (r.integers(-scale, scale + 1, size=(n, 64)) for n in (300, 40))
        x[:40] = c
        frame = C.Frame.of(C.far_apart(c))
        bounds = frame.bounds(frame.distances(x), frame.distances(c))
        exact = np.stack([C.squared(x, k) for k in c], axis=1)
        assert all(int(b) <= int(e) for b, e in zip(bounds.ravel().tolist(), exact.ravel().tolist()))
        best, least, _ = C.nearest(x, frame.distances(x), c, frame)
        assert best.tolist() == exact.argmin(axis=1).tolist() and least.tolist() == exact.min(axis=1).tolist()
    near = np.concatenate([r.integers(-20, 20, size=(200, 64)) + 3000 * k for k in range(20)])
    frame = C.Frame.of(C.far_apart(near[::200]))
    _, _, compared = C.nearest(near, frame.distances(near), near[::200], frame)
    assert compared < 0.2 * len(near) * 20


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(df.repartition(7).withColumn("cluster", F.lit("clash"))) == plain(rows)
