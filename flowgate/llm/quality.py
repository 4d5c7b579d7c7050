"""Quality verdicts: base rules on counts, and a calibrated logistic regression on hashed word and character n-grams.

The regression is fitted on a bounded sample of labelled documents. A text's features are the relative frequencies of its hashed words
and byte trigrams, so its score is a mean of weights, taken by table lookup over the whole text in Arrow batches. A held-back part of
the sample turns scores into probabilities, which fixed thresholds turn into verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import slices, with_fields
from flowgate.llm.labelled import calibrate, logistic, sample

TRAIN_ROWS = 4_000  # labelled documents that are fitted on, at most
BITS = 17  # of each of the two hashed tables
THRESHOLD = 0.5  # probability of good quality from which a text is kept
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
SCALE = 20.0  # of relative frequencies
STEPS, RATE, RIDGE = 150, 0.3, 1e-4

_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_VALUES = np.random.default_rng(7).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BACK = pow(_FACTOR, -1, 1 << 64)
_BLOCK = 1 << 16


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_FACTOR, _BLOCK), _powers(_BACK, _BLOCK)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word; equal words have equal ones wherever they stand."""
    place = np.arange(len(data)) % _BLOCK
    turns = np.arange(len(data)) // _BLOCK
    # the powers start anew in each block; a word that crosses into the next is hashed by itself
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_VALUES[data] * _UP[place])))
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    out = (sums[ends] - sums[begins]) * _DOWN[place[begins]]
    for i in np.flatnonzero(turns[begins] != turns[ends - 1]).tolist():
        h, power = 0, 1
        for v in _VALUES[data[begins[i] : ends[i]]].tolist():
            h = (h + v * power) & (1 << 64) - 1
            power = power * _FACTOR & (1 << 64) - 1
        out[i] = h
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        windows = windows * np.uint64(_FACTOR) + words[j : j + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, dtype=np.int64)
    change[:n] += twice
    change[width:] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Text:
    """Words, counts and hashed features of one text."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode()
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        begins, ends = word_spans(self.bytes)
        self.words = word_hashes(self.bytes, begins, ends)

    def counts(self) -> tuple[int, int, int, int, int]:
        points = int(((self.bytes & 0xC0) != 0x80)[~_SPACE[self.bytes]].sum())
        return len(self.words), points, int(_SYMBOL[self.bytes].sum()), duplicate_lines(self.data), repeated_words(self.words)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words and of the byte trigrams (those in the second table)."""
        words = (self.words >> np.uint64(64 - BITS)).astype(np.int64)
        b = self.bytes.astype(np.uint64)
        grams = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * np.uint64(_FACTOR) if len(b) > 2 else b[:0]
        return words, (1 << BITS) + (grams >> np.uint64(64 - BITS)).astype(np.int64)


def _raw(text: Text, weights: np.ndarray, offset: float) -> float:
    return offset + SCALE * sum(float(weights[f].mean()) for f in text.features() if len(f))


class Model:
    def __init__(self):
        self.weights, self.offset = np.zeros(2 << BITS, dtype=np.float32), 0.0
        self.slope, self.shift = 1.0, 0.0


def _featurized(batches):
    for batch in slices(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            sparse = [np.unique(f, return_counts=True) for f in Text(text).features()]
            rows.append((np.concatenate([i for i, _ in sparse]), np.concatenate([SCALE * c / max(c.sum(), 1) for _, c in sparse])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float64) for _, v in rows], pa.list_(pa.float64()))],
            names=["doc_id", "label", "index", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents; a quarter of them only calibrates. Without labels every text has probability one half."""
    got = sample(docs, labels, "quality", rows, None, id_col, text_col).mapInArrow(_featurized, "doc_id long, label int, index array<int>, value array<double>").toArrow().sort_by("doc_id")
    model = Model()
    y = got.column("label").to_numpy().astype(np.float64)
    if not len(y):
        return model
    index = got.column("index").combine_chunks()
    lengths = np.diff(index.offsets.to_numpy())
    index, value = index.flatten().to_numpy(), got.column("value").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), lengths)
    fitted = np.arange(len(y)) % 4 != 0 if len(y) >= 8 else np.ones(len(y), dtype=bool)
    weight = np.where(fitted, 1.0, 0.0) / max(fitted.sum(), 1)

    w, mean, square = np.zeros(2 << BITS), np.zeros(2 << BITS), np.zeros(2 << BITS)
    bias = 0.0
    for step in range(1, STEPS + 1):
        p = logistic(np.bincount(row, w[index] * value, minlength=len(y)) + bias)
        error = weight * (p - y)
        gradient = np.bincount(index, error[row] * value, minlength=len(w)) + RIDGE * w
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
        bias -= RATE * error.sum()
    model.weights, model.offset = w.astype(np.float32), float(bias)
    raw = np.bincount(row, w[index] * value, minlength=len(y)) + bias
    held = ~fitted if len(set(y[~fitted])) == 2 else np.ones(len(y), dtype=bool)
    model.slope, model.shift = calibrate(raw[held], y[held], np.ones(int(held.sum())))
    return model


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    Null and empty texts have no words, fail the base rules and are not kept. Null ids stay null; repeated rows are judged each; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"]

    def compute(texts):
        model, out = shared.value, []
        for text in map(Text, texts):
            raw = _raw(text, model.weights, model.offset)
            out.append((*text.counts(), float(logistic(np.array(model.slope * raw + model.shift)))))
        return list(zip(*out, strict=True)) or [[]] * len(names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judged = with_fields(texts, "text", compute, [*((n, "long") for n in names[:5]), ("probability", "double")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return judged.select("doc_id", *names[:5], failed.alias("base_failed"), (~failed & (F.col("probability") >= threshold)).alias("kept"), "probability")
