"""SimHash fingerprints and their near-duplicate components by a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most four bits share at least four of their eight bytes, each at its position. The
index has a posting for every triple of byte positions out of a family of 20 which meets every set of four
positions, so no such pair is missed and postings are 24 bits selective. Inside a posting the
shared positional bytes of a pair are tallied; pairs with four or more are verified on their bits.

A posting emits a spanning forest of its links, not the links. Postings with very many fingerprints are cut into blocks, and
pairs of blocks are worked on separately.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import fresh, text_key, with_fields
from flowgate.llm.components import components
from flowgate.staging import stage

SHINGLE = 4
MAX_BITS = 4
BYTES = 8
SHARED = BYTES - MAX_BITS  # positional bytes that a linked pair shares at least
BLOCK = 20_000  # fingerprints of one posting that meet in one step
CHUNK = 255 * 128  # shingles whose bits are counted at once
# The bits of a byte, one in each byte of a 64-bit integer: 255 of them add up without a carry.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def position_family() -> list[tuple[int, int, int]]:
    """Triples of byte positions that meet every four positions: three parts; triples inside one, or two of one and one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    family = [c for part in parts for c in combinations(part, 3)]
    for i, part in enumerate(parts):
        family += [(*two, one) for two in combinations(part, 2) for one in parts[(i + 1) % 3]]
    return family


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles: bit b is 1 if it is set in over half of the shingles' 64-bit hashes. No words: 0."""
    words = (text or "").encode().lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(shingle, len(words))
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(last), CHUNK):
        spans = map(slice, first[at : at + CHUNK], last[at : at + CHUNK])
        digests = b"".join(map(xxhash.xxh64_digest, map(data.__getitem__, spans), repeat(42)))
        lanes = SPREAD[np.frombuffer(digests, dtype=np.uint8)].reshape(-1, BYTES)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, fp) for every row: 64 bits that name the text, and the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_key(text_col), F.lit(0)).alias("content"), F.col(text_col).alias("text"))
    return with_fields(rows, "text", lambda texts: [[_signed(fingerprint(t)) for t in texts]], [("fp", "long")]).drop("text")


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that connect exactly the distinct fingerprints which links among them connect.

    Grows one component after the other; a node that has joined one is not compared again with those that have joined.
    """
    edges = []
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            differing = left ^ node
            shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = shared >= BYTES - max_bits
            near[near] = np.bitwise_count(differing[near]) <= max_bits
            found = left[near]
            if len(found):
                edges += [(int(node), int(x)) for x in found]
                frontier += list(found)
                left = left[~near]
    return edges


def _postings(batches):
    """Streams rows (key, cell, fp) sorted by (key, cell); a group ends where either changes. Groups are bounded by 2 * BLOCK."""
    held: list[np.ndarray] = []
    last = None
    out: list[tuple[int, int]] = []

    def close():
        if held:
            out.extend(forest(np.unique(np.concatenate(held))))
            held.clear()

    for batch in batches:
        key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        if not len(key):
            continue
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if (key[lo], cell[lo]) != last:
                close()
                last = (key[lo], cell[lo])
            if hi - lo > 1 or held or hi == len(key):
                held.append(fp[lo:hi].copy())
        if len(out) > 50_000:
            yield _edges(out)
            out.clear()
    close()
    yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def blocks(entries: DataFrame, block: int) -> DataFrame:
    """The rows (``key`` and others) with a ``cell``: 0, but keys with more rows are cut into blocks, and a cell holds two of them."""
    values = [c for c in entries.columns if c != "key"]
    large = stage(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if large.isEmpty():
        return entries.withColumn("cell", F.lit(0).cast("long"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(text_key(F.col(values[0]).cast("string")), parts)
    # a row is in the cells of its block with every block
    return entries.join(large, "key", "left").select("key", *values, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select(
        "key", *values, (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).cast("long").alias("cell")
    )


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all linked fingerprints of the distinct column ``fp``."""
    shift = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [
        (F.lit(k) * (1 << 24) + shift(x) * 65536 + shift(y) * 256 + shift(z)).cast("long")
        for k, (x, y, z) in enumerate(position_family())
    ]
    entries = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    cells = blocks(entries, block)
    dealt = cells.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_postings, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component) for every distinct ``fp``: the smallest fingerprint of its component."""
    distinct = stage(rows.select("fp").distinct())
    roots = components(links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in at most four bits are linked; ``component_id`` is the smallest id reachable over links,
    the row's own included. Null, empty and wordless texts have fingerprint zero and are linked like any other. A null id stays
    null and never names a component (a component of null ids only is null). Repeated rows are kept. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = stage(_classes(rows).join(least, "fp"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns as they are: that with the smallest id (null ids last).

    Of rows with one id, that with the smallest hash of its text stays; of rows equal in both, any one.
    """
    rows = stage(fingerprints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content"))
    # many copies of one text are one row per task before they are shuffled
    best = rows.groupBy("fp").agg(first.alias("first")).join(_classes(rows), "fp").groupBy("component").agg(F.min("first").alias("first"))
    return one_of_each(docs, best, id_col, text_col)


def one_of_each(docs: DataFrame, best: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each struct ``first`` (a flag, doc_id, content) of ``best``."""
    key, content, d, c = fresh(docs, "row_id", "content", "chosen_id", "chosen_content")
    chosen = stage(best.select(F.col("first.doc_id").alias(d), F.col("first.content").alias(c)))
    keyed = docs.withColumns({key: F.col(id_col).cast("long"), content: F.coalesce(text_key(text_col), F.lit(0))})
    same = F.col(key).eqNullSafe(F.col(d)) & (F.col(content) == F.col(c))
    return keyed.join(chosen, same, "left_semi").dropDuplicates([key, content]).drop(key, content)
