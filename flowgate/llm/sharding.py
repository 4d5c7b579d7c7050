"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Every group of equal texts starts as a partial partition with its bytes in one of k parts. The two partial partitions with
the largest spread are combined, the largest part of one with the smallest of the other, until one is left. Groups are dealt
into blocks of bounded size, each block is differenced in one task, and the blocks' partial partitions are differenced again,
in as many levels as it takes; each level has one vector of k numbers per block of the level before.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgate.staging import stage

SHARDS = 40
BLOCK = 20_000  # groups, or partial partitions, that one task combines
FAN = 512  # partial partitions of blocks that one task combines
SALTS = 64
OVERHEAD = 16  # bytes a row takes besides its text


def difference(parts: np.ndarray) -> np.ndarray:
    """For each partial partition (a row of part sums) the final part of each of its parts.

    Largest spread first, the earlier one of equal spreads; parts are combined in opposite order.
    """
    n, k = parts.shape
    labels = np.empty((n, k), dtype=np.int64)
    if not n:
        return labels
    start = np.argsort(-parts, axis=1, kind="stable")
    sums = [row for row in np.take_along_axis(parts, start, axis=1)]
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(row[-1] - row[0]), i) for i, row in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merges.append((a, b, order))
        sums[a] = sums[b] = None
        heapq.heapreplace(heap, (int(both[-1] - both[0]), len(sums)))
        sums.append(both)
    place = {n + len(merges) - 1: np.arange(k)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        own = place.pop(n + i)
        first, second = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        first[order] = own
        second[k - 1 - order] = own
        place[a], place[b] = first, second
    for i in range(n):
        labels[i, start[i]] = place[i]
    return labels


def _leaves(shards: int):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "g"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(group), shards), dtype=np.int64)
        parts[:, 0] = group["bytes"]
        return pd.DataFrame({"g": group["g"], "bytes": group["bytes"], "block": group["block"], "part": difference(parts)[:, 0]})

    return solve


def _inner(shards: int):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        units = np.sort(group["unit"].unique())
        parts = np.zeros((len(units), shards), dtype=np.int64)
        np.add.at(parts, (np.searchsorted(units, group["unit"]), group["part"]), group["bytes"])
        to = difference(parts)
        return pd.DataFrame({
            "unit": np.repeat(units, shards), "part": np.tile(np.arange(shards), len(units)), "bytes": parts.ravel(),
            "above": group["above"].iloc[0], "to": to.ravel(),
        })

    return solve


def balanced_groups(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(g, part): a part in 0..shards-1 for every distinct binary key ``g`` with its ``bytes``."""
    groups = stage(groups)
    n = max(1, -(-groups.count() // block))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(n)))
    leaves = stage(dealt.groupBy("block").applyInPandas(_leaves(shards), "g binary, bytes long, block long, part int"))
    placed = leaves
    level = leaves.groupBy(F.col("block").alias("unit"), "part").agg(F.sum("bytes").alias("bytes"))
    while n > 1:
        n = -(-n // fan)
        merged = stage(
            level.withColumn("above", F.pmod("unit", F.lit(n))).groupBy("above").applyInPandas(_inner(shards), "unit long, part int, bytes long, above long, to int")
        )
        # the parts so far become the parts of the block above
        moves = merged.select(F.col("unit").alias("block"), "part", "above", "to")
        placed = placed.join(moves, ["block", "part"]).select("g", "bytes", F.col("above").alias("block"), F.col("to").alias("part"))
        level = merged.groupBy(F.col("above").alias("unit"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
    return placed.select("g", "part")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law).

    Rows with equal texts go to one shard; a null text counts as an empty one. ``slot`` numbers the rows of a shard from 0 without
    gaps, in an order that depends on ids and texts only. Null ids stay null, repeated rows are placed each, other columns are
    ignored, an empty table gives no rows. A group larger than a shard's share cannot be balanced away: it fills its shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"),
    ))
    parts = balanced_groups(rows.groupBy("g").agg(F.sum("size").alias("bytes")), shards, block, fan)
    placed = stage(rows.join(parts, "g").select("doc_id", "size", "text_crc32", F.col("part").alias("shard"), F.pmod(F.xxhash64("doc_id", "g"), F.lit(SALTS)).cast("int").alias("salt")))
    # shards x SALTS rows at most
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("inside", inside).join(F.broadcast(before), ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("inside") + F.col("before") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
