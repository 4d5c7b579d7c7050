"""Periodic runs in texts: maximal stretches of words that repeat with one period, found with suffix trees.

Every run holds, from each order of the words, Lyndon words of its period's length: for one of two opposite orders the longest Lyndon word that
starts somewhere in the run is as long as its period. So each place and order gives one candidate, which is
extended to the right by the longest common extension of its two ends and to the left by that of the reversed text. Extensions are depths of
lowest common ancestors in suffix trees (built by Ukkonen's method, one of the words and one of their reversal) and take constant time on
an Euler tour with a sparse table. The order of the leaves is that of the suffixes, from which the longest Lyndon words follow with a stack.

A run of at least ``SHORTEST`` words and three periods lies inside stretches of words that occur twice in its text, ``WINDOW`` words at a time, for the
part before its last period is equal to that after its first one, and is two thirds of it. Trees are built of such
stretches only, and a text without them, as most are, has no run. A text is worked on as a whole: memory grows with its longest stretch
(some 600 bytes a word), not with the number of rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import slices

SHORTEST = 24  # words
PERIODS = 3
WINDOW = SHORTEST - SHORTEST // PERIODS  # words of a run that are found again one period later

_ODD = np.random.default_rng(20_250_812).integers(0, 1 << 63, size=6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class SuffixTree:
    """Suffix tree of whole numbers from 1 on, by Ukkonen's on-line method; a last symbol 0 ends each suffix in a leaf of its own."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        n, width = len(text), max(text) + 1
        begin, end, link = [0], [0], [0]  # edge into a node: text[begin:end]; a leaf's ends with the text
        child: dict[int, int] = {}  # node * width + first symbol of the edge
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i), end.append(n), link.append(0)
                    if last:
                        link[last] = node
                    last = 0
                else:
                    whole = (end[below] if end[below] < i else i) - begin[below]
                    if length >= whole:
                        edge, length, node = edge + whole, length - whole, below
                        continue
                    if text[begin[below] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(begin)
                    begin.append(begin[below]), end.append(begin[below] + length), link.append(0)
                    child[key] = middle
                    child[middle * width + symbol] = middle + 1
                    begin.append(i), end.append(n), link.append(0)
                    begin[below] += length
                    child[middle * width + text[begin[below]]] = below
                    if last:
                        link[last] = middle
                    last = middle
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.n, self._nodes = n, len(begin)
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        below = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        del child
        order = np.argsort(keys)
        self._parent, self._first, self._below = keys[order] // width, keys[order] % width, below[order]
        self._length = np.minimum(np.array(end), n) - np.array(begin)

    def tour(self) -> None:
        """Euler tour in ascending order of the symbols: ranks of the suffixes, and the table that answers common extensions."""
        starts = np.searchsorted(self._parent, np.arange(self._nodes + 1)).tolist()
        below, length, n = self._below.tolist(), self._length.tolist(), self.n
        leaves, between = [], []  # suffix of each leaf, depth of the node through which the tour goes on to the next one
        stack = [(0, 0, starts[0])]  # node, its depth, next child
        while stack:
            node, depth, at = stack.pop()
            if at > starts[node]:
                between.append(depth)
            if at + 1 < starts[node + 1]:
                stack.append((node, depth, at + 1))
            child = below[at]
            deeper = depth + length[child]
            if starts[child] == starts[child + 1]:
                leaves.append(n - deeper)
            else:
                stack.append((child, deeper, starts[child]))
        self.suffixes = np.array(leaves)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[self.suffixes] = np.arange(n)
        self._table = [np.array(between, dtype=np.int32)]
        step = 1
        while 2 * step <= len(between):
            row = self._table[-1]
            self._table.append(np.minimum(row[:-step], row[step:]))
            step *= 2

    def falling_rank(self) -> np.ndarray:
        """Ranks of the suffixes if greater symbols come first; the end of the text still comes before all."""
        depth = [0] * self._nodes
        starts = np.searchsorted(self._parent, np.arange(self._nodes + 1)).tolist()
        below, first, length, n = self._below.tolist(), self._first.tolist(), self._length.tolist(), self.n
        leaves, stack = [], [0]
        while stack:
            node = stack.pop()
            a, b = starts[node], starts[node + 1]
            if a == b:
                leaves.append(n - depth[node])
                continue
            for x in below[a:b]:
                depth[x] = depth[node] + length[x]
            # taken from the stack's end: the end symbol, if any, then the greatest
            stack += [*below[a + 1 : b], below[a]] if first[a] == 0 else below[a:b]
        rank = np.empty(n, dtype=np.int64)
        rank[leaves] = np.arange(n)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the places a and b (different ones, up to the end of the text)."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            row = self._table[k]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << k)])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """For each place the end of the longest Lyndon word from there: the next place whose suffix comes earlier."""
    ranks = rank.tolist()
    out, stack = [0] * len(ranks), []
    for i in range(len(ranks) - 1, -1, -1):
        own = ranks[i]
        while stack and ranks[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] if stack else len(ranks)
        stack.append(i)
    return np.array(out)


def runs_of(symbols: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of the given length in whole numbers, by start, then period."""
    m = len(symbols)
    if m < max(shortest, periods):
        return np.zeros((0, 3), dtype=np.int64)
    values = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(values)
    tree.tour()
    places = np.arange(m)
    candidates = []
    for rank in (tree.rank, tree.falling_rank()):
        ends = lyndon_ends(rank[:m])
        some = (ends - places) * periods <= m
        candidates.append(places[some] * (m + 1) + ends[some])
    a, b = np.divmod(np.unique(np.concatenate(candidates)), m + 1)
    right = tree.common(a, np.minimum(b, m))  # the end symbol's own suffix has nothing in common with any other
    del tree
    tree = SuffixTree(values[::-1])
    tree.tour()
    left = tree.common(m - a, m - b)
    found = np.stack([a - left, b + right - (a - left), b - a], axis=1)
    found = np.unique(found[found[:, 1] >= np.maximum(shortest, periods * found[:, 2])], axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _repeated(symbols: np.ndarray, window: int) -> np.ndarray:
    """Which places lie in a window of symbols that occurs again (or shares its 64 bits with another one)."""
    n = len(symbols)
    covered = np.zeros(n, dtype=bool)
    if n <= window:
        return covered
    hashes, done, k = symbols.astype(np.uint64) * _ODD[0], 1, 1
    hashes ^= hashes >> np.uint64(29)
    while done < window:
        step = min(done, window - done)
        hashes = hashes[:-step] * _ODD[k % 5 + 1] + hashes[step:]
        hashes ^= hashes >> np.uint64(31)
        done, k = done + step, k + 1
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if same.any():
        marks = np.zeros(n + 1, dtype=np.int64)
        starts = np.zeros(len(hashes), dtype=bool)
        starts[order[1:][same]] = starts[order[:-1][same]] = True
        at = np.flatnonzero(starts)
        marks[at] += 1
        marks[at + window] -= 1
        covered = np.cumsum(marks)[:n] > 0
    return covered


def runs(words: list[bytes], shortest: int = SHORTEST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs of a text's words."""
    ids: dict[bytes, int] = {}
    symbols = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    window = max(shortest - shortest // periods, 1)
    covered = np.concatenate(([False], _repeated(symbols, window), [False]))
    edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
    found = [runs_of(symbols[a:b], shortest, periods) + [a, 0, 0] for a, b in edges.tolist()]
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those behind the first period of a run."""
    marks = np.zeros(n + 1, dtype=np.int64)
    if len(found):
        np.add.at(marks, found[:, 0] + found[:, 2], 1)
        np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return np.cumsum(marks)[:n] == 0


def foremost(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest ratio of length to period, exactly; ties go to the smallest start, then period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def repeating_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the report: of one id in ten (by crc32 of its decimal digits) the words from one place on repeat with a period that the id tells."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


_COLUMNS = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(pa.list_(pa.int64())), "collapsed": pa.string(),
}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False, shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, its foremost run (start, length, period, exponent_milli), digests, ``runs`` and ``collapsed``.

    Words lie between ASCII white space and are equal if their bytes are. A run is a stretch of words with smallest period q, at least
    ``shortest`` words and ``periods`` times q long, that cannot be extended. ``runs`` lists [start, length, period]; ``collapsed`` is the text
    with one period of each run. Null, empty and wordless texts have no words and no run; repeated rows are kept, null ids stay
    null, other columns are ignored. ``tails`` first rewrites texts by ``repeating_tail`` (rows with a null id stay as they are).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def judged(batches):
        for batch in slices(batches, "text"):
            out: dict[str, list] = {name: [] for name in _COLUMNS}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or "").encode().split()
                if tails:
                    words = repeating_tail(words, doc)
                found = runs(words, shortest, periods)
                start, length, period = foremost(found) or (None, None, None)
                kept = b" ".join(w for w, stays in zip(words, collapsed(len(words), found).tolist(), strict=True) if stays) if len(found) else b" ".join(words)
                listed = found.tolist()
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed).encode()
                values = (
                    doc, len(found), start, length, period, None if length is None else 1000 * length // period,
                    hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest(), listed, kept.decode(),
                )
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in _COLUMNS.items()], names=list(_COLUMNS))

    return rows.mapInArrow(
        judged, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<array<long>>, collapsed string"
    )
