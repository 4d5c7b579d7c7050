"""Toxic passages as maximal-scoring segments of token log-odds, with extreme-value statistics.

The numbers of toxic and of clean documents with a word, with its first five and with its first four letters give each word
a log-odds under a Dirichlet prior: a word's prior is the rate of its five letters, theirs that of the four letters, theirs the overall
rate. Scores are shifted so that ordinary words are negative. One linear scan finds all maximal-scoring segments of
a document, repeated ones too. By the theory of such segments the best chance score in n words has an extreme-value distribution, P(S >= x) =
1 - exp(-K n exp(-lambda x)); lambda and K are estimated on clean documents. Passages that are unlikely by chance are reported,
and a document's score is the calibrated probability that belongs to the surprise of all segments, or of the best one, in a second
scan where a word counts at its first place only.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import fresh, kept, slices, with_fields
from flowgate.llm.decontam import words_of
from flowgate.llm.labelled import calibrate, logistic, sample
from flowgate.staging import stage

TRAIN_ROWS = 20_000  # labelled documents that are learnt from, at most
BUCKETS = 1 << 18  # hashed tokens per level
LEVELS = 3  # first four letters, first five, whole word
STRENGTH = 4.0  # prior, in documents
SHIFT = 1.0  # taken from every log-odds
LAMBDAS = np.linspace(0.25, 6.0, 24)
FROM = 3.0  # segment score at which clean documents are counted for K
CHANCE = 0.05  # a passage is reported if fewer are expected by chance
THRESHOLD = 0.7
KINDS = (0, 1)  # plain scores, each word once
KNOWN_WORDS = 150_000  # scored words that a worker keeps, some 25 MB


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def _buckets(word: bytes) -> tuple[int, int, int]:
    text = word.decode(errors="ignore")
    return tuple(level * BUCKETS + zlib.crc32(bytes([level]) + part.encode()) % BUCKETS for level, part in enumerate((text[:4], text[:5], text)))


class Scores(dict):
    """Shifted log-odds of words from the documents per bucket, toxic ones and all; the last entry counts documents."""

    def __init__(self, toxic: np.ndarray, both: np.ndarray):
        super().__init__()
        self.toxic, self.both = toxic, both
        self.rate = float((toxic[-1] + 0.5) / (both[-1] + 1))

    def __missing__(self, word: bytes) -> float:
        rate = self.rate
        for bucket in _buckets(word):
            rate = (self.toxic[bucket] + STRENGTH * rate) / (self.both[bucket] + STRENGTH)
        score = float(np.log(rate / (1 - rate)) - np.log(self.rate / (1 - self.rate)) - SHIFT)
        if len(self) < KNOWN_WORDS:
            self[word] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), in order; linear in the number of scores.

    Only positive scores can begin or end one. Each new candidate is merged with the earlier ones as long as that gives a better whole.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # begin, end, sum before, sum after
    below: list[int] = []  # for each candidate the nearest earlier one with a smaller sum before, or -1
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, sums[i], sums[i + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = below[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                below.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], below[j:]
    return [(b, e, float(after - before)) for b, e, before, after in found]


def _once(words: list[bytes], scores: np.ndarray) -> np.ndarray:
    """The scores with every positive word counted at its first place only."""
    out, seen = scores.copy(), set()
    for i in np.flatnonzero(scores > 0).tolist():
        if words[i] in seen:
            out[i] = -SHIFT
        seen.add(words[i])
    return out


def _scan(text: str | None, table: Scores, passages: bool = True) -> tuple[list[np.ndarray], list[list[tuple[int, int, float]]]]:
    """Scores of the words and their segments, plain (if passages are asked for) and each word once."""
    words = words_of(text)
    plain = np.fromiter(map(table.__getitem__, words), dtype=np.float64, count=len(words))
    scores = [plain, _once(words, plain)]
    return scores, [segments(plain) if passages else [], segments(scores[1])]


def _counted(batches):
    """Documents with a label: per bucket the numbers by fold (remainder 0 or 2) and label; the last bucket counts all."""
    counts = np.zeros((4, LEVELS * BUCKETS + 1), dtype=np.int64)
    for batch in slices(batches, "text"):
        for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
            counts[2 * fold + label, list({b for word in set(words_of(text)) for b in _buckets(word)})] += 1
            counts[2 * fold + label, -1] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(counts[i, some]) for i in range(4))], names=["bucket", "c0", "t0", "c2", "t2"])


class Model:
    """Counts, extreme-value parameters and calibration; of a size that does not depend on the data."""

    def __init__(self, toxic: np.ndarray, both: np.ndarray):
        self.toxic, self.both, self.key = toxic, both, uuid.uuid4().hex
        self.decay, self.scale = [1.0, 1.0], [1.0, 1.0]  # of the plain scores, and of each word once
        self.slope, self.offset = 1.0, 0.0

    def surprise(self, score: float, n: int, kind: int = 0) -> float:
        """Minus the logarithm of the number of segments as good as this one that chance gives in n words."""
        return self.decay[kind] * score - float(np.log(self.scale[kind] * max(n, 1)))


def _overall(surprises: list[float]) -> float:
    """All surprising segments together, or else the best one; between -40 (no segment) and 60."""
    some = sum(x for x in surprises if x > 0)
    return min(60.0, some) if some else max([-40.0, *surprises])


def _table(model: Model) -> Scores:
    return kept(("words", model.key), lambda: Scores(model.toxic, model.both))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` labelled documents that are not held out. Without any, every score is the same."""
    spark = docs.sparkSession
    own = sample(docs, labels, "toxic", rows, remainder(F.col("id")) != 1, id_col, text_col).withColumn("fold", (remainder(F.col("doc_id")) / 2).cast("int"))
    counts = own.mapInArrow(_counted, "bucket long, c0 long, t0 long, c2 long, t2 long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c2", "t2")]).toArrow()
    dense = np.zeros((4, LEVELS * BUCKETS + 1), dtype=np.float32)
    for i, c in enumerate(("c0", "t0", "c2", "t2")):
        dense[i, counts.column("bucket").to_numpy()] = counts.column(c).to_numpy()
    # documents of one fold are scored with the counts of the other
    folds = spark.sparkContext.broadcast([Model(dense[3], dense[2] + dense[3]), Model(dense[1], dense[0] + dense[1])])

    def judged(batches):
        tables = [Scores(m.toxic, m.both) for m in folds.value]
        for batch in slices(batches, "text"):
            out = {"label": batch.column("label").to_pylist(), "n": [], "found0": [], "found1": [], "sums": []}
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                scores, found = _scan(text, tables[fold])
                out["n"].append(len(scores[0]))
                for kind in KINDS:
                    out[f"found{kind}"].append([s for _, _, s in found[kind]])
                out["sums"].append([float(np.exp(x * scores[kind]).sum()) for kind in KINDS for x in LAMBDAS])
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int64(), doubles, doubles, doubles), strict=True)], names=list(out))

    seen = stage(own.mapInArrow(judged, "label int, n long, found0 array<double>, found1 array<double>, sums array<double>"))
    over = [F.sum(F.exists(f"found{kind}", lambda x: x >= FROM).cast("int")).alias(f"over{kind}") for kind in KINDS]
    clean = seen.where("label = 0").agg(F.sum("n").alias("n"), *over, *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(KINDS) * len(LAMBDAS))]).first()
    model = Model(dense[1] + dense[3], dense.sum(axis=0))
    if clean["n"]:
        # the positive root of E[exp(lambda s)] = 1
        for kind in KINDS:
            mean = np.array([clean[f"s{kind * len(LAMBDAS) + i}"] for i in range(len(LAMBDAS))]) / clean["n"]
            above = np.flatnonzero(mean >= 1)
            model.decay[kind] = float(LAMBDAS[above[0]] if len(above) else LAMBDAS[-1])
            model.scale[kind] = max(clean[f"over{kind}"], 0.5) / (clean["n"] * float(np.exp(-model.decay[kind] * FROM)))
    surprises = F.transform("found1", lambda x: model.decay[1] * x - F.log(F.lit(model.scale[1]) * F.greatest("n", F.lit(1))))
    some = F.aggregate(F.filter(surprises, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    z = F.when(some > 0, F.least(F.lit(60.0), some)).otherwise(F.greatest(F.lit(-40.0), F.coalesce(F.array_max(surprises), F.lit(-40.0))))
    cells = seen.groupBy((F.round(z * 4) / 4).alias("z"), "label").agg(F.count("*").alias("n")).collect()  # at most 2 x 401 rows
    z, label, n = (np.array([r[i] for r in cells], dtype=np.float64) for i in range(3))
    model.slope, model.offset = calibrate(z, label, n)
    return model


def _judge(model, text, table: Scores, passages: bool = True) -> tuple[float, list[int], list[float]]:
    scores, (plain, once) = _scan(text, table, passages)
    n = len(scores[0])
    best = _overall([model.surprise(s, n, 1) for _, _, s in once])
    found = [(model.surprise(s, n), b, e) for b, e, s in plain]
    likely = [f for f in found if f[0] >= -np.log(CHANCE)]
    return float(logistic(np.array(model.slope * best + model.offset))), [x for _, b, e in likely for x in (b, e)], [f[0] for f in likely]


def _scored(df: DataFrame, text_col: str, model: Model, names: list[str], passages: bool = True) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        table = _table(shared.value)
        return list(zip(*(_judge(shared.value, t, table, passages) for t in texts), strict=True)) or ([], [], [])

    return with_fields(df, text_col, compute, list(zip(names, ("double", "array<int>", "array<double>"), strict=True)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, passages: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages (begin, end, ... in words), surprise of each.

    The score does not need the scan for passages; with ``passages=False`` none are listed. Null and empty texts have no words and the score of a document without any segment. A null id counts as the empty text for
    ``held_out``. Repeated rows get the same score. Other columns are ignored, labels included.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = _scored(texts, "text", train(docs, labels, id_col, text_col, rows), ["score", "passages", "surprise"], passages)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "surprise")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are, also those named like results.

    Null, empty and wordless texts have the score of a document without any segment and stay unless that is toxic; rows of equal texts
    share their fate; null ids are never learnt from. An empty table stays empty.
    """
    names = fresh(docs, "score", "passages", "surprise")
    return _scored(docs, text_col, train(docs, labels, id_col, text_col, rows), names, passages=False).where(F.col(names[0]) < threshold).drop(*names)
