"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of benchmark items. For the patterns of one length a table gives, for each block of
two words, how far the search may move on; a block that occurs nowhere in them skips a whole window less one word. Where the shift
is zero, the patterns that end in this block and begin with the words found at their start are
looked up in a bucket and compared word by word.

The benchmark is searched in blocks of bounded size: one block's tables are sent to the executors, all documents are scanned
against it, and hits of several blocks are combined per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import fresh, kept, text_key, with_fields
from flowgate.staging import stage

WINDOW = 10
BLOCK_BYTES = 4 << 20  # benchmark text whose tables are in memory at once

# A-Z become a-z; other ASCII characters but digits and letters separate words; bytes from 0x80 on are parts of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Length:
    """Shift table and suffix buckets of all patterns of one length."""

    def __init__(self, size: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.size = size
        self.block = min(2, size)
        self.skip = size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, size + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.skip), size - end)
            bucket = self.buckets.setdefault(pattern[-self.block :], {})
            bucket.setdefault(pattern[: self.block], []).append((pattern, items))

    def search(self, words: list[bytes], hits: bytearray, items: set[str]) -> None:
        size, block, skip = self.size, self.block, self.skip
        shift, buckets = self.shift.get, self.buckets
        n, end = len(words), size
        mark = b"\1" * size
        while end <= n:
            last = tuple(words[end - block : end])
            move = shift(last, skip)
            if move:
                end += move
                continue
            begin = end - size
            found = buckets[last].get(tuple(words[begin : begin + block]))
            if found:
                here = tuple(words[begin:end])
                for pattern, named in found:
                    if pattern == here:
                        hits[begin:end] = mark
                        items.update(named)
            end += 1


class Matcher:
    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        lengths: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in rows:
            words = tuple(words_of(text))
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                lengths.setdefault(size, {}).setdefault(words[i : i + size], set()).add(item)
        self.lengths = [Length(size, patterns) for size, patterns in sorted(lengths.items())]

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Number of words, hit runs as begin, end, begin, end, ... and the items found."""
        words = words_of(text)
        hits, items = bytearray(len(words)), set()
        for length in self.lengths:
            length.search(words, hits, items)
        if not items:
            return len(words), [], []
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(hits) + b"\0", dtype=np.int8)))
        return len(words), edges.tolist(), sorted(items)


def _tables(rows: tuple, window: int) -> Matcher:
    return kept(("patterns", rows, window), lambda: Matcher(list(rows), window))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Benchmark rows as (item, text) in blocks of about ``block_bytes``; at least one block, which may be empty."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield n, tuple((r["item"], r["text"]) for r in own.collect())


def _scan(df: DataFrame, column: str, rows: tuple, window: int, names: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rows)

    def compute(texts):
        matcher = _tables(shared.value, window)
        return list(zip(*map(matcher.search, texts), strict=True)) or ([], [], [])

    return with_fields(df, column, compute, list(zip(names, ("long", "array<int>", "array<string>"), strict=True)))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs (hit word ranges), items.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null, empty and wordless texts have no words
    and no hits; such items have no windows. Rows of one item_id are one item; a null item_id is the item "null". A null doc_id stays
    null. Repeated rows each get their result. Other columns are ignored. An empty benchmark finds nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["n_words", "runs", "items"]
    scanned = []
    for n, block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        keyed = rows if n == 1 else rows.withColumn("content", text_key("text"))
        scanned.append(_scan(keyed, "text", block, window, names).drop("text"))
    found = scanned[0]
    if len(scanned) > 1:
        some = scanned[0]
        for one in scanned[1:]:
            some = some.union(one)
        some = some.where(F.size("items") > 0).groupBy(F.col("doc_id").alias("d"), F.col("content").alias("c")).agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = found.select("doc_id", "content", "n_words").join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left")
    none = F.array().cast("array<int>")
    pairs = F.coalesce("runs", none)
    begins = F.filter(pairs, lambda _, i: i % 2 == 0)
    ends = F.filter(pairs, lambda _, i: i % 2 == 1)
    runs = F.array_sort(F.arrays_zip(begins.alias("begin"), ends.alias("end")))
    items = F.coalesce("items", F.array().cast("array<string>"))
    # runs of several blocks may overlap: count what lies beyond the furthest end so far
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, r: F.struct((a.n + F.greatest(F.lit(0), r.end - F.greatest(r.begin, a.to))).alias("n"), F.greatest(a.to, r.end).alias("to")),
        lambda a: a.n.cast("long"),
    )
    return found.select("doc_id", "n_words", runs.alias("runs"), items.alias("items")).select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (covered > 0).alias("contaminated"), "runs", "items",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are."""
    kept = docs
    for n, block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        names = fresh(docs, "n_words", "runs", "items")
        kept = _scan(kept, text_col, block, window, names).where(F.size(names[2]) == 0).drop(*names)
        kept = stage(kept) if n > 1 else kept
    return kept


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` is, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
