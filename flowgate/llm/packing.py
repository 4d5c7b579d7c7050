"""Sequence packing by minimum bin slack.

Documents are cut into whole windows and one remainder. Remainders count only by length, so all that is packed is a
multiset of at most ``capacity - 1`` lengths, whatever the number of documents. For each window a subset-sum program
over bit sets finds the multiset of lengths that comes closest to the capacity, its counts are read back, and the
window is repeated as often as the counts allow. Where no multiset fills the window, one more remainder is cut to fill it; its
rest stays in the multiset. Documents are numbered inside (length, salt) groups and take their place from the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgate.llm.common import ARROW, from_texts, text_key
from flowgate.llm.tokens import byte_bpe, installed_added, installed_bpe
from flowgate.staging import stage

CAPACITY = 1024
SALTS = 16  # groups that documents with equal remainders are numbered in
END_OF_TEXT = 0


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is as near to ``room`` as possible without exceeding it.

    Bit s of a set says that sum s can be reached. Counts enter in powers of two; the sets before each step are
    kept to read the counts back.
    """
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            grown = (sums | sums << length * times) & mask
            if grown != sums:
                steps.append((sums, length, times))
                sums = grown
            left -= times
            times *= 2
        if sums >> room & 1:
            break
    goal = sums.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> goal & 1:
            used[length] = used.get(length, 0) + times
            goal -= length * times
    return used


class Plan:
    """Where the items of each class go.

    Classes 0..capacity-1 are the remainders of that length; further ones are rests of cut items. An entry of a class
    says: from item ``first`` on, item j of the entry goes to bin ``base + (skip + j) // each`` at offset
    ``at + (skip + j) % each * length``; ``child`` is the class of the rest where the item is cut to ``length``, else -1.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.entries: dict[int, list[tuple]] = {}
        self.firsts: dict[int, list[int]] = {}
        waiting = {n: deque([[n, 0, count]]) for n, count in histogram.items() if 0 < n < capacity and count > 0}
        counts = {n: count for n, count in histogram.items() if 0 < n < capacity and count > 0}
        classes = capacity
        while counts:
            longest = max(counts)
            counts[longest] -= 1
            used = fill(counts, capacity - longest)
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            slack = capacity - sum(n * k for n, k in used.items())
            cut = 0
            if slack:  # whatever is left is longer than the slack
                cut = max((n for n, count in counts.items() if count > used.get(n, 0) and n > slack), default=0)
            need = {n: k + (n == cut) for n, k in used.items()}
            if cut and cut not in need:
                need[cut] = 1
            times = min(counts[n] // k for n, k in need.items())
            at = 0
            for n in sorted(used, reverse=True):
                self._take(waiting[n], n, used[n] * times, used[n], at, -1)
                at += n * used[n]
            if cut:
                self._take(waiting[cut], slack, times, 1, at, classes)
                counts[cut - slack] = counts.get(cut - slack, 0) + times
                waiting.setdefault(cut - slack, deque()).append([classes, 0, times])
                classes += 1
            for n, k in need.items():
                counts[n] -= k * times
            counts = {n: c for n, c in counts.items() if c}
            self.bins += times

    def _take(self, queue: deque, length: int, items: int, each: int, at: int, child: int) -> None:
        skip = 0
        while skip < items:
            head = queue[0]
            n = min(head[2], items - skip)
            self.entries.setdefault(head[0], []).append((head[1], self.bins, each, at, length, skip, child))
            self.firsts.setdefault(head[0], []).append(head[1])
            head[1] += n
            head[2] -= n
            skip += n
            if not head[2]:
                queue.popleft()

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(bin, offset, length) of each piece of the remainder number ``rank`` of that length."""
        pieces, kind, rest = [], length, length
        while rest:
            i = bisect.bisect_right(self.firsts[kind], rank) - 1
            first, base, each, at, taken, skip, child = self.entries[kind][i]
            j = skip + rank - first
            pieces.append((base + j // each, at + j % each * taken, taken))
            rest -= taken
            # items of a cut class come in the order in which they were cut
            kind, rank = child, j
        return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: document, place in it, CRC of its ids, sequence and offset there, and the ids (unsigned 32-bit, little-endian).

    Each document is its ids and one end-of-text id, so an empty or null text is a piece of one id. A null document id
    stays null; repeated rows are packed each by themselves; other columns are ignored; an empty table gives no rows. All sequences
    are full but for the last one. ``keep_ids=False`` leaves the ids of whole windows out of the rows that are moved.
    """
    vocabulary, pattern = tokenizer or installed_bpe()
    added = () if tokenizer else installed_added()

    def make(batch):
        bpe = byte_bpe(vocabulary, pattern, added)
        out = {k: [] for k in ("doc_id", "n", "rem", "whole", "crcs", "tail", "full")}
        for doc, encoded in zip(batch.column(0).to_pylist(), map(bpe.encode, batch.column(1).to_pylist()), strict=True):
            ids = np.append(encoded, np.uint32(END_OF_TEXT)).astype("<u4")
            whole = len(ids) // capacity
            cut = whole * capacity
            out["doc_id"].append(doc)
            out["n"].append(len(ids))
            out["rem"].append(len(ids) - cut)
            out["whole"].append(whole)
            out["crcs"].append([zlib.crc32(ids[i : i + capacity].tobytes()) for i in range(0, cut, capacity)])
            out["tail"].append(ids[cut:].tobytes())
            out["full"].append(ids[:cut].tobytes() if keep_ids else b"")
        return out

    encoded = stage(from_texts(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", make,
        "doc_id long, n long, rem int, whole long, crcs array<long>, tail binary, full binary",
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id", "tail"), F.lit(SALTS)).cast("int")))

    # At most capacity x SALTS groups, whatever the number of documents.
    groups = encoded.groupBy("rem", "salt").agg(F.count("*").alias("items"), F.sum("whole").alias("whole")).orderBy("rem", "salt").collect()
    histogram: dict[int, int] = {}
    begin: dict[tuple[int, int], tuple[int, int]] = {}
    windows = 0
    for g in groups:
        begin[g.rem, g.salt] = (histogram.get(g.rem, 0), windows)
        histogram[g.rem] = histogram.get(g.rem, 0) + g["items"]
        windows += g.whole
    plan = Plan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast((plan, begin))
    schema = [(f.split()[0], ARROW[f.split()[1]]) for f in PIECES.split(", ")]

    def pieces(batches):
        plan, begin = shared.value
        for batch in batches:
            out = {name: [] for name, _ in schema}

            def add(doc, start, length, crc, n, sequence, offset, ids):
                for name, value in zip(out, (doc, start, length, crc, n, sequence, offset, ids), strict=True):
                    out[name].append(value)

            for row in batch.to_pylist():
                rank, window = begin[row["rem"], row["salt"]]
                for i, crc in enumerate(row["crcs"]):
                    ids = row["full"][4 * i * capacity : 4 * (i + 1) * capacity] if keep_ids else None
                    add(row["doc_id"], i * capacity, capacity, crc, row["n"], plan.bins + window + row["before"] + i, 0, ids)
                start = row["whole"] * capacity
                for sequence, offset, length in plan.place(row["rem"], rank + row["place"]) if row["rem"] else ():
                    ids = row["tail"][4 * (start - row["whole"] * capacity) :][: 4 * length]
                    add(row["doc_id"], start, length, zlib.crc32(ids), row["n"], sequence, offset, ids if keep_ids else None)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(out[name], type=kind) for name, kind in schema], names=list(out))

    order = Window.partitionBy("rem", "salt").orderBy("doc_id", text_key("tail"), "n")
    numbered = encoded.select(
        "*", (F.row_number().over(order) - 1).alias("place"),
        (F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("whole")).alias("before"),
    )
    return numbered.mapInArrow(pieces, PIECES)
