"""Records of CSV files by byte blocks, so that many tasks share one file whose quoted fields hold line breaks.

Whether a line feed ends a record depends on the number of quotes before it, from the start of the file on. Each block is read once for what it
does to that state: its quotes, and its record ends for either state at its start. A running sum over the blocks of a file then
fixes the state and the record number at each block's start, and each block is read by a task of its own. A record belongs to the
block that holds the end of the record before it, and is read to its end wherever that is.

This holds for files whose quotes open and close whole fields and are doubled inside. Other quotes, and quotes that stay open, are
noticed while blocks are counted; see ``irregular``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowgate.sources.heads import MARKED, OTHER, _opened

BLOCK_BYTES = 64 << 20
CHUNK = 1 << 20  # bytes that a task looks at together
TASK_BYTES = 8 << 20  # small blocks share a task up to so many bytes
RECORDS = 10_000  # records that are handed on together
QUOTE, COMMA, FEED, RETURN = b'",\n\r'
_BESIDE = (COMMA, FEED, RETURN, QUOTE, -1)
_BESIDE_TABLE = np.isin(np.arange(256), _BESIDE)

# Tasks carry these helpers with them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _chunks(path: str, begin: int, end: int | None = None, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) from ``begin`` to ``end`` or the file's end, ``size`` bytes at a time."""
    with _opened(path) as file:
        end = file.size() if end is None else min(end, file.size())
        file.seek(begin)
        while begin < end and (chunk := file.read(min(size, end - begin))):
            yield begin, chunk
            begin += len(chunk)


def block_facts(path: str, begin: int, end: int, start: int, quotes: bool = True) -> tuple[int, int, int, bool, bool]:
    """Quotes modulo 2, record ends if the block starts outside and inside quotes, and whether a quote would be out of place then.

    ``start`` is the place of the file's first character; a quote there opens a field. Without ``quotes`` they are characters like others.
    """
    parity, ends, wrong = 0, [0, 0], [False, False]
    before = -1  # the byte before the chunk; none yet
    for at, chunk in _chunks(path, max(begin - 1, start), end + 1):
        data = np.frombuffer(chunk, dtype=np.uint8)
        lead = 1 if at < begin else 0  # a byte of the block before
        tail = len(data) - max(at + len(data) - end, 0)  # bytes of this block
        following = -1
        if at + len(data) < end + 1:
            # what follows the last byte is in the next chunk
            nearby = next(iter(_chunks(path, at + len(data), at + len(data) + 1)), None)
            following = nearby[1][0] if nearby else -1
        own = slice(lead, tail)
        # around each byte one of the few that may stand beside a quote; nothing stands before and after the file
        beside = np.concatenate(([before in _BESIDE], _BESIDE_TABLE[data], [following in _BESIDE]))
        quote = (data[own] == QUOTE) & quotes
        state = (np.bitwise_xor.accumulate(quote) ^ quote ^ bool(parity)).view(np.uint8)  # before each byte, if the block starts outside
        feed = data[own] == FEED
        opens = quote & ~beside[:-2][own]
        closes = quote & ~beside[2:][own]
        for inside in (0, 1):
            outside = state == inside
            ends[inside] += int((feed & outside).sum())
            wrong[inside] |= bool((opens & outside).any() or (closes & ~outside).any())
        parity = int((quote.sum() + parity) & 1)
        before = int(data[-1])
    return parity, ends[0], ends[1], wrong[0], wrong[1]


def _arrow(data: bytes, lengths: np.ndarray, encoding: str, strip_return: bool) -> pa.Array:
    """Texts of records that lie end to end, each with its line feed."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    raw = pc.binary_slice(raw, 0, -1)
    if strip_return:
        raw = pc.if_else(pc.ends_with(raw, b"\r"), pc.binary_slice(raw, 0, -1), raw)
    if encoding != OTHER:
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            pass
    return pa.array([x.decode(encoding, errors="replace") for x in raw.to_pylist()], pa.string())


def block_records(path: str, begin: int, end: int, inside: int, number: int, encoding: str, returns: bool, quotes: bool = True) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(numbers, texts) of the records that belong to a block, the file's first one with the number 1; ``number`` counts record ends before it."""
    open_ = begin == (3 if encoding == MARKED else 0)  # behind the mark, if there is one
    encoding = "utf-8" if encoding == MARKED else encoding
    number += 1 if open_ else 2
    state, held = inside, []
    # a small block is read as such; what its last record has beyond it, in pieces of the same size
    for at, chunk in _chunks(path, begin, size=min(CHUNK, max(end - begin, 1 << 12))):
        data = np.frombuffer(chunk, dtype=np.uint8)
        after = (np.bitwise_xor.accumulate((data == QUOTE) & quotes) ^ bool(state)).view(np.uint8)
        stops = np.flatnonzero((data == FEED) & (after == 0))
        state, low = int(after[-1]), 0
        if not open_:
            if not len(stops):
                if at + len(chunk) >= end:
                    return
                continue
            if at + stops[0] >= end:
                return
            open_, low, stops = True, int(stops[0]) + 1, stops[1:]
        past = int(np.searchsorted(at + stops, end))
        done = past < len(stops)
        stops = stops[: past + 1]
        for first in range(0, len(stops), RECORDS):
            some = stops[first : first + RECORDS]
            before = b"".join(held)
            lengths = np.diff(np.concatenate(([low - 1 - len(before)], some)))
            yield np.arange(number, number + len(some)), _arrow(before + chunk[low : some[-1] + 1], lengths, encoding, returns)
            number += len(some)
            held, low = [], int(some[-1]) + 1
        if done:
            return
        held.append(chunk[low:])
    held = b"".join(held)
    if open_ and held:
        yield np.array([number]), _arrow(held + b"\n", np.array([len(held) + 1]), encoding, returns)


_FACTS = "path string, encoding string, returns boolean, begin long, end long, parity int, ends0 long, ends1 long, wrong0 boolean, wrong1 boolean"


def counted_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES, quotes: bool = True) -> DataFrame:
    """One row per block of the files (path, size_bytes, encoding, returns): its place, and what it does to either state. Reads every file once."""
    start = F.when(F.col("encoding") == MARKED, F.lit(3)).otherwise(F.lit(0)).cast("long")
    cut = files.where("size_bytes > 0").select(
        "path", "encoding", "returns", start.alias("start"), "size_bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(block_bytes).cast("long"))).alias("at"),
    )
    blocks = cut.select("path", "encoding", "returns", "start", F.greatest("at", "start").alias("begin"), F.least(F.col("at") + block_bytes, "size_bytes").alias("end")).where("begin < end")

    def count(batches):
        for batch in batches:
            rows = batch.to_pylist()
            facts = list(zip(*(block_facts(r["path"], r["begin"], r["end"], r["start"], quotes) for r in rows), strict=True))
            arrays = [pa.array(c, t) for c, t in zip(facts, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("path", "encoding", "returns", "begin", "end")] + arrays, names=[f.split()[0] for f in _FACTS.split(", ")])

    return _dealt(blocks).mapInArrow(count, _FACTS)


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks are few and small rows: each gets a task of its own, up to ten thousand tasks; small ones share tasks of ``TASK_BYTES``, once all cores have some."""
    n, size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    tasks = max(-(-size // TASK_BYTES), 2 * blocks.sparkSession.sparkContext.defaultParallelism)
    return blocks.repartition(min(max(n, 1), tasks, 10_000))


def placed_blocks(counted: DataFrame) -> DataFrame:
    """The blocks with the state (``inside``) and the number of record ends before each, and ``irregular`` for files with quotes out of place."""
    order = W.partitionBy("path").orderBy("begin")
    whole = W.partitionBy("path")
    inside = F.coalesce(F.sum("parity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    known = counted.withColumn("inside", inside.cast("int")).withColumn("ends", F.when(F.col("inside") == 0, F.col("ends0")).otherwise(F.col("ends1")))
    number = F.coalesce(F.sum("ends").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wrong = F.when(F.col("inside") == 0, F.col("wrong0")).otherwise(F.col("wrong1"))
    irregular = F.max(wrong).over(whole) | (F.sum("parity").over(whole) % 2 == 1) | (F.sum("ends").over(whole) == 0)
    return known.select("path", "encoding", "returns", "begin", "end", "inside", number.alias("number"), irregular.alias("irregular"))


def records_of(blocks: DataFrame, quotes: bool = True) -> DataFrame:
    """(path, returns, line, value): the records of placed blocks as raw text, numbered from 1 in their file, empty lines counted but left out."""

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for numbers, texts in block_records(r["path"], r["begin"], r["end"], r["inside"], r["number"], r["encoding"], r["returns"], quotes):
                    some = pc.greater(pc.binary_length(texts), 0)
                    out = pa.RecordBatch.from_arrays(
                        [pa.array([r["path"]] * len(texts), pa.string()), pa.array([r["returns"]] * len(texts), pa.bool_()), pa.array(numbers), texts], names=["path", "returns", "line", "value"]
                    )
                    yield out.filter(some)

    return _dealt(blocks).mapInArrow(read, "path string, returns boolean, line long, value string")
