"""Texts that share most of their five-word strings: a positional byte index with count filtering, every candidate verified by its exact similarity.

A text is the set of its ``WIDTH``-word strings, and two texts are linked if their Jaccard similarity is at least 0.8. Such texts differ
in 5 to 13 of 64 SimHash bits, too many for an index of fingerprints that stays selective. So the positional bytes are those of a longer
fingerprint: one byte of each of ``ROWS * BANDS`` minimum hashes, of which two texts share as many as they are similar. The index has one posting for each
band of ``ROWS`` positions, named by the positional bytes themselves; a pair at 0.8 meets in none of them with a probability of (1 - 0.8 ** ROWS) ** BANDS, 7 in a million, a more similar pair less
often. In a posting the shared positional bytes of a pair are tallied, and pairs with at least ``MAYBE`` of them are candidates.

Links of the SimHash fingerprints of the five-word strings, found as ``simhash`` finds them and verified, come first; the longer fingerprint finds the others.
Its pairs are looked for in two passes, so that a large group of copies does not give all its pairs. In the first one each text of a posting is
paired with one other at most: a text takes all those that are probably its links with it. Verified links make components. In the second pass only postings with
texts of different components are left. The candidates between components, of which a posting tells a spanning forest, make clusters; each text is sent to
its cluster once, and there all candidates between components are verified, so no link is lost to the first pass. Clusters beyond ``CELL`` texts are cut
into blocks, every two of which meet. The comparisons are quadratic only in texts that are nearly, but not quite, similar to many others; rows are not.

"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm import simhash
from flowgate.llm.common import release, slices, text_key
from flowgate.llm.components import components
from flowgate.llm.simhash import BLOCK, blocks, one_of_each
from flowgate.staging import stage

WIDTH = 5
FIFTHS = 4  # of five: the similarity that links
ROWS, BANDS = 5, 30
MAYBE = 0.65  # share of positional bytes from which a pair is verified; at similarity 0.8 it errs by 0.033
LIKELY = 0.8  # from here on a text goes with the one that it is compared with, for the first pass
CHUNK = 512
FLUSH = 50_000  # pairs that a task holds at most, but for those of one posting
CELL = 500  # texts of a cluster that meet, with as many others, in one step

_RANDOM = np.random.default_rng(20_260_117).integers(0, 1 << 63, size=(2, ROWS * BANDS), dtype=np.uint64)
_FACTORS, _TERMS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word strings, words folded as in the fingerprint; a shorter text is one string, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[min(WIDTH, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(last)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def minima(own: np.ndarray) -> np.ndarray:
    out = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(out, (own[at : at + CHUNK, None] * _FACTORS + _TERMS).min(axis=0), out=out)
    return out


def keys_of(least: np.ndarray) -> np.ndarray:
    """The postings of a text: for each band its number and its ``ROWS`` positional bytes, 48 bits as they are."""
    own = np.frombuffer(sketch_of(least), dtype=np.uint8).reshape(BANDS, ROWS).astype(np.int64)
    return (np.arange(BANDS) << 8 * ROWS) | (own << 8 * np.arange(ROWS)).sum(axis=1)


def sketch_of(least: np.ndarray) -> bytes:
    """A byte of each minimum."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def likely_pairs(sketches: np.ndarray) -> list[tuple[int, int, float]]:
    """Pairs (row, row, share), at most one for each row as the second one."""
    out = []
    left = np.arange(len(sketches))
    while len(left) > 1:
        node, left = left[0], left[1:]
        share = (sketches[left] == sketches[node]).mean(axis=1)
        near = share >= LIKELY
        out += [(int(node), x, e) for x, e in zip(left[near].tolist(), share[near].tolist(), strict=True)]
        left = left[~near]
    return out


def bridges(sketches: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, row) of different components that connect all rows which candidates between components connect; fewer than rows."""
    out = []
    left = np.arange(len(sketches))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = ((sketches[left] == sketches[node]).mean(axis=1) >= MAYBE) & (roots[left] != roots[node])
            found = left[near].tolist()
            out += [(int(node), x) for x in found]
            frontier += found
            left = left[~near]
    return out


def links_between(sketches: np.ndarray, roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (row, row) that connect all components which similar rows of different ones connect. Every candidate is compared until its ends are connected."""
    number = np.unique(np.array(roots), return_inverse=True)[1]
    out = []
    for node in range(len(sets) - 1):
        near = (sketches[node + 1 :] == sketches[node]).mean(axis=1) >= MAYBE
        for x in (np.flatnonzero(near & (number[node + 1 :] != number[node])) + node + 1).tolist():
            if number[x] != number[node] and similar(sets[node], sets[x]):
                out.append((node, x))
                number[number == number[x]] = number[node]
    return out


def _sketched(batches):
    release()
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        least = [minima(shingles(t)) for t in texts]
        prints = np.array([simhash.fingerprint(t, WIDTH) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("content"), pa.array([keys_of(x) for x in least], pa.list_(pa.int64())), pa.array(map(sketch_of, least), pa.binary()), pa.array(prints)],
            names=["doc_id", "content", "keys", "sketch", "fp"],
        )


def _groups(batches, *columns):
    """Rows sorted by (key, cell), a list of tuples for each group."""
    last, group = None, []
    for batch in batches:
        for key, cell, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", *columns)), strict=True):
            if (key, cell) != last:
                if len(group) > 1:
                    yield group
                last, group = (key, cell), []
            group.append(row)
    if len(group) > 1:
        yield group


def _met(batches):
    """The texts that share a key with another one."""
    met: set[int] = set()
    for group in _groups(batches, "content"):
        met.update(x for (x,) in group)
        if len(met) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64())], names=["content"])
            met.clear()
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64())], names=["content"])


def _pairs(columns: dict, names: list[str]) -> pa.RecordBatch:
    kinds = {"estimate": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.int64())) for n in names], names=names)


def _likely(batches):
    names = ["a", "b", "estimate"]
    out: list[tuple] = []
    for group in _groups(batches, "content", "sketch"):
        own = sorted(dict(group).items())
        sketches = np.frombuffer(b"".join(s for _, s in own), dtype=np.uint8).reshape(len(own), -1)
        out += [(min(own[i][0], own[j][0]), max(own[i][0], own[j][0]), e) for i, j, e in likely_pairs(sketches)]
        if len(out) > FLUSH:
            yield _pairs(dict(zip(names, zip(*out, strict=True), strict=True)), names)
            out.clear()
    if out:
        yield _pairs(dict(zip(names, zip(*out, strict=True), strict=True)), names)


def _bridged(batches):
    out: list[tuple] = []
    for group in _groups(batches, "content", "sketch", "root"):
        own = sorted({content: (sketch, root) for content, sketch, root in group}.items())
        content = [c for c, _ in own]
        sketches = np.frombuffer(b"".join(s for _, (s, _) in own), dtype=np.uint8).reshape(len(own), -1)
        out += [(content[i], content[j]) for i, j in bridges(sketches, np.array([r for _, (_, r) in own], dtype=np.int64))]
        if len(out) > FLUSH:
            yield _pairs(dict(zip("ab", zip(*out, strict=True), strict=True)), ["a", "b"])
            out.clear()
    if out:
        yield _pairs(dict(zip("ab", zip(*out, strict=True), strict=True)), ["a", "b"])


def _cells_linked(batches):
    release()
    for group in _groups(batches, "content", "root", "sketch", "text"):
        own = sorted({content: rest for content, *rest in group}.items())
        sketches = np.frombuffer(b"".join(r[1] for _, r in own), dtype=np.uint8).reshape(len(own), -1)
        found = links_between(sketches, [r[0] for _, r in own], [shingles(r[2]) for _, r in own])
        if found:
            yield _pairs({"a": [own[i][0] for i, _ in found], "b": [own[j][0] for _, j in found]}, ["a", "b"])


def _verified(batches):
    last, own = None, None
    for batch in slices(batches, "text_b"):
        ends = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            if a != last:
                last, own = a, shingles(x)
            if similar(own, shingles(y)):
                ends.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar."""
    side = lambda x: texts.select(F.col("content").alias(x), F.col("text").alias(f"text_{x}"))
    return stage(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"))


def _joined(links_: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, root) of all contents: the smallest one of the component, itself where it has no link."""
    roots = components(links_)
    return contents.join(roots, F.col("content") == F.col("node"), "left").select("content", F.coalesce("root", "content").alias("root"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) between different components."""
    root = lambda x: roots.select(F.col("content").alias(x), F.col("root").alias(f"root_{x}"))
    return pairs.join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b").select("a", "b")


def _close(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of contents, the smaller one first, that connect all whose SimHash fingerprints are equal or linked; ``prints`` are (content, fp)."""
    least = stage(prints.groupBy("fp").agg(F.min("content").alias("least")))
    equal = prints.join(least, "fp").select(F.col("least").alias("a"), F.col("content").alias("b"))
    end = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}"))
    linked = simhash.links(least.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return stage(equal.union(linked).where("a <> b").distinct())


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between contents that connect all similar ones; ``rows`` are (content, keys, sketch, fp), ``docs`` (content, text)."""
    distinct = stage(rows.groupBy("content").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")))
    close = _close(distinct.select("content", "fp"))
    dealt = lambda entries: entries.repartition("key", "cell").sortWithinPartitions("key", "cell")
    entries = blocks(distinct.select("content", F.explode("keys").alias("key")), BLOCK).select("key", "cell", "content")
    met = stage(dealt(entries).mapInArrow(_met, "content long").distinct())
    meeting = distinct.join(met, "content").select("content", "sketch", F.explode("keys").alias("key"))
    cells = stage(blocks(meeting, BLOCK).select("key", "cell", "content", "sketch"))
    ends = met.union(close.select("a")).union(close.select("b")).distinct()
    texts = stage(docs.dropDuplicates(["content"]).join(ends, "content", "left_semi"))
    near = _verify(close, texts)

    # first pass: each text's best pair; of its other ones only those that would join two components are compared
    pairs = stage(dealt(cells).mapInArrow(_likely, "a long, b long, estimate double").distinct())
    best = pairs.select(F.col("a").alias("x"), "a", "b", "estimate").union(pairs.select("b", "a", "b", "estimate")).groupBy("x").agg(F.max(F.struct("estimate", "a", "b")).alias("p"))
    found = near.union(_verify(best.select("p.a", "p.b").distinct().join(close, ["a", "b"], "left_anti"), texts))
    found = found.union(_verify(_apart(pairs, _joined(found, met)), texts))

    # second pass: postings with texts of different components
    roots = stage(_joined(found, met))
    named = stage(cells.join(roots, "content"))
    mixed = named.groupBy("key", "cell").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", "cell")
    clusters = components(stage(dealt(named.join(mixed, ["key", "cell"])).mapInArrow(_bridged, "a long, b long").distinct()))
    members = clusters.select(F.col("node").alias("content"), F.col("root").alias("key")).join(roots, "content").join(distinct.select("content", "sketch"), "content").join(texts, "content")
    meeting = blocks(stage(members.select("content", "root", "sketch", "text", "key")), CELL)
    return found.union(stage(dealt(meeting).mapInArrow(_cells_linked, "a long, b long")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of similar texts, all columns as they are, chosen as ``simhash.keep_one`` does.

    Null, empty and wordless texts are similar to each other, so one of them stays. Of repeated rows one stays; a null id is kept only where no
    other row of the component has one. Columns named like those used here, ``content`` or ``keys`` say, are kept. An empty table stays empty.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_key(text_col), F.lit(0)).alias("content"), F.col(text_col).alias("text"))
    rows = stage(texts.mapInArrow(_sketched, "doc_id long, content long, keys array<long>, sketch binary, fp long"))
    roots = components(links(rows, texts.select("content", "text")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content"))
    least = rows.groupBy("content").agg(first.alias("first")).join(roots, F.col("content") == F.col("node"), "left")
    return one_of_each(docs, least.groupBy(F.coalesce("root", "content").alias("component")).agg(F.min("first").alias("first")), id_col, text_col)
