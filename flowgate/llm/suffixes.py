"""Removal of long repeated byte strings with a logarithmic family of sparse suffix indexes.

A string of ``LENGTH`` bytes that occurs twice contains the same *anchors* at both places: the start whose next ``PREFIX`` bytes have the
smallest fingerprint of all starts in the string. Each text is reduced to its anchors, one per 150 bytes or so, and each anchor
owns the strings that chose it. The suffixes that begin at anchors, ordered by the fingerprint of their first bytes so that equal
beginnings are neighbours, are the suffix array of a batch of documents.

Batches enter an index family one after the other. The array of a new batch is merge-scanned against the array of every level for
beginnings that occur there too, then it becomes a level itself; two levels of equal rank merge into one of
the next rank, so there are at most log2(batches) + 1 levels, and an entry is rewritten as many times.

What the scans find is settled exactly: equal surroundings are counted by 128-bit fingerprints, and anchors whose surroundings
differ are compared with each other, to the left and to the right. A beginning with very many different
surroundings is settled string by string, spread over all tasks, so no group of any size meets in one place.

The same can be done over words in place of bytes: a text is then the sequence of 64-bit hashes of its words, and a rule says how many of
them make a string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import fresh, release, slices, text_key
from flowgate.staging import passing, stage, stage_path

LENGTH = 400
PREFIX = 100
BATCHES = 4
HOT = 1000  # surroundings that occur in more than one of so many places are told to all tasks
MANY = 8192  # different surroundings of one beginning that are compared in one task, some 6 MB
FEW = 48  # up to so many are compared in pairs, byte by byte; more of them by the fingerprints of their strings
CHUNK = 1 << 18  # string starts worked on at once, however long a text is


class Rule(NamedTuple):
    """What counts as a repeated string: so many symbols (bytes, or words between white space), and how many of them make its anchor."""

    length: int
    prefix: int
    words: bool

    def symbols(self, data: bytes) -> np.ndarray:
        if not self.words:
            return np.frombuffer(data, dtype=np.uint8)
        words = data.split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))

    def loaded(self, context: bytes) -> np.ndarray:
        return np.frombuffer(context, dtype=np.uint64 if self.words else np.uint8)


LONG_STRINGS = Rule(LENGTH, PREFIX, False)
PASSAGES = Rule(51, 13, True)  # over fifty words

_MULTIPLIER = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses modulo 2**64


@lru_cache(maxsize=1)
def _fingerprint_tables():
    """For both fingerprints: a random value per byte, the powers of the multiplier and of its inverse."""
    n = CHUNK + LENGTH + 1
    values = np.random.default_rng(20_240_229).integers(0, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for table, factor in zip(values, _MULTIPLIER, strict=True):
        powers = np.full(n, factor, dtype=np.uint64)
        back = np.full(n, pow(factor, -1, 1 << 64), dtype=np.uint64)
        powers[0] = back[0] = 1
        out.append((table, np.cumprod(powers), np.cumprod(back)))
    return out


def _prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    table, powers, _ = _fingerprint_tables()[which]
    values = table[data] if data.dtype == np.uint8 else _mixed(data ^ table[0]) | np.uint64(1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(data)], out=sums[1:])
    return sums


def _strings(sums: np.ndarray, starts, ends, which: int) -> np.ndarray:
    """Fingerprints of data[starts:ends] wherever they lie."""
    return (sums[ends] - sums[starts]) * _fingerprint_tables()[which][2][starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIER[0])
    return h ^ (h >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: bytes, rule: Rule = LONG_STRINGS) -> tuple[np.ndarray, ...]:
    """Anchors of a text: position, symbols before and after it in the strings that chose it, fingerprint of the next
    ``prefix`` symbols, and two fingerprints of all of them. Every string start belongs to one anchor."""
    found = []
    length, prefix, _ = rule
    whole = rule.symbols(data)
    for at in range(0, len(whole) - length + 1, CHUNK):
        part = whole[at : at + CHUNK + length - 1]
        sums = _prefix_sums(part, 0)
        starts = np.arange(len(part) - prefix + 1)
        heads = _mixed((sums[prefix:] - sums[:-prefix]) * _fingerprint_tables()[0][2][: len(starts)])
        # the low bits hold the place, so that the leftmost of equal fingerprints wins
        least = _sliding_min((heads & np.uint64(~0xFFFFF & (1 << 64) - 1)) | starts.astype(np.uint64), length - prefix + 1)
        chosen = (least & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
        end = np.append(first[1:] - 1, len(chosen) - 1) + length
        own = chosen[first]
        other = _prefix_sums(part, 1)
        found.append((own + at, own - first, end - own, heads[own], _strings(sums, first, end, 0), _strings(other, first, end, 1)))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))


class LevelFamily:
    """Suffix arrays of earlier batches in levels of geometrically growing size."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Takes in the suffixes (``key``) of a batch; returns (key, n) of its beginnings that occur twice or more so far."""
        self._merge()
        array = stage(suffixes.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"))
        scan, total = array, F.col("n")
        for rank, level in self.levels:
            scan = scan.join(level.select("key", F.col("n").alias(f"n{rank}")), "key", "left")
            total = total + F.coalesce(f"n{rank}", F.lit(0))
        matches = scan.select("key", total.alias("n")).where("n > 1")
        matches = stage(matches)
        self.levels.append((0, array))
        return matches

    def _merge(self) -> None:
        """Two levels of equal rank become one of the next rank. This is done when a batch comes, so nothing is merged that no batch is scanned against."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, array), (_, level) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, stage(level.union(array).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"))))


_ANCHORS = "doc_id long, content long, pos int, before int, after int, key long, c1 long, c2 long, batch int"


def _find_anchors(batches_count: int, rule: Rule):
    names = [f.split()[0] for f in _ANCHORS.split(", ")]

    def rows(batches):
        release()
        for batch in slices(batches, "text"):
            parts = []
            for doc, content, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "text")), strict=True):
                own = anchors_of((text or "").encode(), rule)
                if len(own[0]):
                    parts.append((doc, content, own))
            if not parts:
                continue
            counts = [len(own[0]) for _, _, own in parts]
            spread = np.repeat(np.arange(len(parts)), counts)
            docs = pa.array([d for d, _, _ in parts], type=pa.int64()).take(pa.array(spread))
            content = np.array([c for _, c, _ in parts], dtype=np.int64)[spread]
            columns = [np.concatenate([own[i] for _, _, own in parts]) for i in range(6)]
            arrays = [docs, pa.array(content), *(pa.array(c.astype(np.int32)) for c in columns[:3]), *(pa.array(c) for c in columns[3:])]
            arrays.append(pa.array((content % batches_count).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


_CONTEXT = "key long, many boolean, single boolean, doc_id long, content long, pos int, before int, context binary"


def _cut_contexts(rule: Rule):
    names = [f.split()[0] for f in _CONTEXT.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def rows(batches):
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                data = rule.symbols((row["text"] or "").encode())
                for w in row["wanted"]:
                    context = data[w["pos"] - w["before"] : w["pos"] + w["after"]].tobytes()
                    values = (w["key"], w["many"], w["single"], row["doc_id"], row["content"], w["pos"], w["before"], context)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=names)

    return rows


_SPANS = "doc_id long, content long, begin int, end int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "content", "begin", "end"])


def _differences(pieces: list[np.ndarray]) -> np.ndarray:
    """Rows of symbols, padded with values that equal nothing in another row."""
    kind = np.int32 if pieces[0].dtype == np.uint8 else np.uint64
    out = np.repeat(np.arange(len(pieces), dtype=kind)[:, None] + kind(256), max(map(len, pieces)) + 1, axis=1)
    for i, piece in enumerate(pieces):
        out[i, : len(piece)] = piece
    return out


def settle(group: list[tuple], rule: Rule = LONG_STRINGS) -> list[tuple]:
    """Repeated symbols around one anchor of each single entry (single, doc_id, content, pos, before, context) of one beginning."""
    if len(group) > FEW:
        return _settle_by_strings(group, rule)
    contexts = [(b, rule.loaded(c)) for *_, b, c in group]
    left = _differences([c[:b][::-1] for b, c in contexts])
    right = _differences([c[b:] for b, c in contexts])
    spans = []
    for i, (single, doc, content, pos, _, _) in enumerate(group):
        if not single:
            continue
        before = (left != left[i]).argmax(axis=1)
        after = (right != right[i]).argmax(axis=1)
        valid = before + after >= rule.length
        valid[i] = False
        if valid.any():
            spans.append((doc, content, pos - int(before[valid].max()), pos + int(after[valid].max())))
    return spans


def _own_strings(before: int, context: bytes, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every string that an entry owns the distance to the anchor and two fingerprints."""
    data = rule.loaded(context)
    starts = np.arange(len(data) - rule.length + 1)
    return before - starts, *(_strings(_prefix_sums(data, w), starts, starts + rule.length, w) for w in (0, 1))


def _settle_by_strings(group: list[tuple], rule: Rule) -> list[tuple]:
    own = [_own_strings(before, context, rule) for *_, before, context in group]
    entry = np.repeat(np.arange(len(group)), [len(x) for x, _, _ in own])
    x, first, second = (np.concatenate([o[i] for o in own]) for i in range(3))
    order = np.argsort(first, kind="stable")
    same = (x[order][1:] == x[order][:-1]) & (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    twice = np.zeros(len(x), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    entry, x = entry[twice], x[twice]
    most, least = np.full(len(group), -1), np.full(len(group), rule.length)
    np.maximum.at(most, entry, x)
    np.minimum.at(least, entry, x)
    return [(doc, content, pos - int(most[i]), pos - int(least[i]) + rule.length) for i, (single, doc, content, pos, _, _) in enumerate(group) if single and most[i] >= 0]


def _settle_sorted(rule: Rule):
    def rows(batches):
        key, group, spans = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "single", "doc_id", "content", "pos", "before", "context")), strict=True):
                if row[0] != key:
                    if len(group) > 1:
                        spans += settle(group, rule)
                    key, group = row[0], []
                group.append(row[1:])
            yield _spans(spans)
            spans = []
        if len(group) > 1:
            spans += settle(group, rule)
        yield _spans(spans)

    return rows


_STRINGS = "key long, single boolean, doc_id long, content long, pos int, x int, s1 long, s2 long"


def _all_strings(rule: Rule):
    """Every string that an entry owns: its distance to the anchor and its 128-bit fingerprint."""

    def rows(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "single", "doc_id", "content", "pos", "before", "context")), strict=True):
                key, single, doc, content, pos, before, context = row
                x, *hashes = _own_strings(before, context, rule)
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key)), pa.array([single] * n, type=pa.bool_()), pa.array([doc] * n, type=pa.int64()), pa.array(np.full(n, content)),
                     pa.array(np.full(n, pos, dtype=np.int32)), pa.array(x.astype(np.int32)), *(pa.array(h.view(np.int64)) for h in hashes)],
                    names=[f.split()[0] for f in _STRINGS.split(", ")],
                )

    return rows


def repeated_spans(docs: DataFrame, batches: int = BATCHES, many: int = MANY, rule: Rule = LONG_STRINGS) -> DataFrame:
    """(doc_id, content, begin, end): ranges of bytes (words) of the texts of (doc_id, content, text) which together are all repeated ones.

    ``content`` is 64 bits of the text; rows equal in both are copies of each other and share their ranges.
    """
    path = stage_path(docs.sparkSession)
    docs.mapInArrow(_find_anchors(batches, rule), _ANCHORS).write.partitionBy("batch").parquet(path)
    anchors = docs.sparkSession.read.schema(_ANCHORS).parquet(path)

    family = LevelFamily()
    found = None
    for b in range(batches):
        matches = family.add(anchors.where(F.col("batch") == b))
        found = matches if found is None else found.union(matches)
    # a written table, so that the join may split the rows of a frequent key
    repeated = stage(found.select("key").distinct())
    candidates = stage(anchors.drop("batch").join(repeated, "key"))

    same = ["key", "c1", "c2", "before", "after"]
    classes = stage(candidates.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "content", "pos")).alias("one")))
    # surroundings that hold more than one row in HOT are at most HOT ones; their rows stay where they are
    hot = stage(classes.where((F.col("n") > 1) & (F.col("n") * HOT > candidates.count())).select(*same, F.lit(True).alias("hot")))
    marked = candidates.join(F.broadcast(hot), same, "left")
    again = marked.where("hot is null").join(classes.where("n > 1").select(*same), same, "left_semi")
    begin_end = ["doc_id", "content", (F.col("pos") - F.col("before")).alias("begin"), (F.col("pos") + F.col("after")).alias("end")]
    copies = again.select(*begin_end).union(marked.where("hot").select(*begin_end))

    # beginnings with several surroundings, some of which occur once
    mixed = classes.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    wanted = classes.join(mixed.select("key", (F.col("m") > many).alias("many")), "key").select(
        F.col("one.doc_id").alias("d"), F.col("one.content").alias("c"),
        F.struct("key", "many", (F.col("n") == 1).alias("single"), F.col("one.pos").alias("pos"), "before", "after").alias("w"),
    ).groupBy("d", "c").agg(F.collect_list("w").alias("wanted"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))).select("doc_id", "content", "text", "wanted")
    contexts = stage(texts.mapInArrow(_cut_contexts(rule), _CONTEXT))
    few = contexts.where(~F.col("many")).repartition("key").sortWithinPartitions("key").mapInArrow(_settle_sorted(rule), _SPANS)
    spans = copies.union(few)
    crowded = contexts.where("many")
    if not crowded.isEmpty():
        strings = stage(crowded.mapInArrow(_all_strings(rule), _STRINGS))
        which = ["key", "x", "s1", "s2"]
        twice = strings.groupBy(*which).agg(F.count("*").alias("n")).where("n > 1").select(*which)
        hit = strings.where("single").join(twice, which, "left_semi").groupBy("doc_id", "content", "pos").agg(F.max("x").alias("most"), F.min("x").alias("least"))
        spans = spans.union(hit.select("doc_id", "content", F.col("pos") - F.col("most"), F.col("pos") - F.col("least") + rule.length))
    return spans


def _merged(spans: list[dict], data: bytes) -> list[tuple[int, int]]:
    """Runs of bytes; spans of words reach from the first byte of their first word to the last one of their last."""
    words = [m.span() for m in re.finditer(rb"\S+", data)] if any(s["words"] for s in spans) else []
    return _joined((words[s["begin"]][0], words[s["end"] - 1][1]) if s["words"] else (s["begin"], s["end"]) for s in spans)


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that meet or overlap as one."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def _written_spans(docs: DataFrame, batches: int, many: int, rule: Rule) -> DataFrame:
    """The repeated spans by one rule as a table; anchors, levels and surroundings are deleted before the next rule makes its own."""
    spark = docs.sparkSession
    path = stage_path(spark)
    with passing(spark):
        spans = repeated_spans(docs, batches, many, rule)
        spans.write.parquet(path)
    return spark.read.schema(spans.schema).parquet(path)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, batches: int, many: int, rules: Sequence[Rule]) -> tuple[DataFrame, str]:
    """All rows and columns with the spans of their text in one more column."""
    key, content, spans, d, c = fresh(docs, "row_id", "content", "spans", "span_id", "span_content")
    rows = docs.withColumns({key: F.col(id_col).cast("long"), content: text_key(text_col)})
    plain = rows.select(F.col(key).alias("doc_id"), F.col(content).alias("content"), F.col(text_col).alias("text"))
    each = [_written_spans(plain, batches, many, rule).withColumn("words", F.lit(rule.words)) for rule in rules]
    found = reduce(DataFrame.union, each).groupBy(F.col("doc_id").alias(d), F.col("content").alias(c)).agg(F.collect_set(F.struct("words", "begin", "end")).alias(spans))
    joined = rows.join(stage(found), F.col(key).eqNullSafe(F.col(d)) & (F.col(content) == F.col(c)), "left")
    return joined.drop(key, content, d, c), spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, many: int = MANY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words, kept (the remaining bytes).

    Every byte inside a string of 400 bytes that also starts anywhere else is removed, copies on all sides. Passages are not removed here but reported: stretches of
    words that lie in strings of 51 words which also start anywhere else, however short the words are. Null and empty texts and texts under
    both lengths have neither. Rows equal in id and text are copies of each other like any others. Null ids stay null; other columns
    are ignored. What is left may end inside a character, so ``kept`` is binary.
    """
    joined, spans = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", batches, many, [LONG_STRINGS, PASSAGES])

    def rows(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", spans)), strict=True):
                data = (text or "").encode()
                runs = _merged([s for s in found or [] if not s["words"]], data)
                passages = _joined((s["begin"], s["end"]) for s in found or [] if s["words"])
                kept = _without(data, runs)
                values = (doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(passages), sum(e - b for b, e in passages), kept)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=names)

    return joined.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, kept binary")


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for begin, end in runs:
        parts.append(data[at:begin])
        at = end
    parts.append(data[at:])
    return b"".join(parts)


def _cut(data: bytes, spans: list[dict]) -> bytes:
    return _without(data, _merged(spans, data))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, many: int = MANY, rules: Sequence[Rule] = (LONG_STRINGS,)) -> DataFrame:
    """All rows and columns of ``docs`` with repeated strings cut out of the text; bytes of a cut character go with it.

    What is repeated by any of the rules goes; each looks at the whole texts. A text without repeats stays as it is, null and empty ones included, and
    no row is dropped. Repeated rows are copies of each other and lose the same strings. Null ids are ids like any other. Columns named like those
    used here, ``content`` or ``spans`` say, are kept. An empty table stays empty.
    """
    joined, spans = _with_spans(docs, id_col, text_col, batches, many, rules)
    names = docs.columns

    def rows(batches):
        for batch in slices(batches, text_col):
            texts = []
            for text, found in zip(batch.column(text_col).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                texts.append(_cut(text.encode(), found).decode(errors="ignore") if found else text)
            columns = [pa.array(texts, type=batch.column(n).type) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(rows, docs.schema)
