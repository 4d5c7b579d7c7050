"""Language of texts by a bidirectional gated recurrent network over bytes.

The bytes of a text (A-Z folded) are cut into windows of ``STEPS`` bytes. One network reads each window forwards, another one backwards; from both states
every byte gets a distribution over the languages, and the document's is the normalised mean of their logarithms over all
its bytes. The last window of a text ends with it, and bytes that two windows share count once; a short text is filled up with spaces that do
not count.

The network is trained in numpy: back-propagation through all steps of a window in both directions, Adam, gradients cut at a norm. Windows of up to
``TRAIN_DOCS`` documents of each of up to ``LANGUAGES`` languages are learnt from, chosen by hash of their ids, so what the driver
holds is bounded (``LANGUAGES * TRAIN_DOCS * TRAIN_WINDOWS * STEPS`` bytes, 31 MB) and the same in each run. Everything else covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowgate.llm.common import slices
from flowgate.staging import stage

STEPS = 64
HIDDEN = 12  # per direction
LANGUAGES = 64  # the most frequent ones are learnt
TRAIN_DOCS = 500  # per language
TRAIN_WINDOWS = 15  # per document
SHOWN = 40_000  # windows that are shown in training, repeated ones included
BATCH = 256
RATE, DECAY1, DECAY2 = 0.01, 0.9, 0.99
MAX_NORM = 5.0
TOGETHER = 2048  # windows that are read at once
SPACE = 32
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Cell:
    """A gated recurrent layer, features first: the gates are halved sums under tanh, so that sigmoid(x) = (1 + tanh(x / 2)) / 2."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.x = (rng.normal(size=(3 * hidden, 256)) * 0.3).astype(np.float32)  # update, reset, new state: by byte
        self.u = (rng.normal(size=(3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros((hidden, 1), dtype=np.float32)  # of the recurrent part of the new state

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b]

    def states(self, steps: np.ndarray) -> tuple[np.ndarray, list]:
        """(step, hidden, window) states after each step of ``steps`` (step, window), and what back-propagation needs."""
        n, hidden = steps.shape[1], self.u.shape[1]
        h = np.zeros((hidden, n), dtype=np.float32)
        out, kept = np.empty((len(steps), hidden, n), dtype=np.float32), []
        for t, byte in enumerate(steps):
            a = np.take(self.x, byte, axis=1)
            g = self.u @ h
            gates = np.tanh(0.5 * (a[: 2 * hidden] + g[: 2 * hidden])) * 0.5 + 0.5
            update, reset = gates[:hidden], gates[hidden:]
            inner = g[2 * hidden :] + self.b
            new = np.tanh(a[2 * hidden :] + reset * inner)
            kept.append((h, update, reset, inner, new))
            h = new + update * (h - new)
            out[t] = h
        return out, kept

    def gradients(self, steps: np.ndarray, kept: list, towards: np.ndarray) -> list[np.ndarray]:
        """Of the parameters, where ``towards`` is the loss's gradient in each state."""
        hidden = self.u.shape[1]
        dx, du, db = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros_like(towards[0])
        for t in range(len(steps) - 1, -1, -1):
            h, update, reset, inner, new = kept[t]
            dh = dh + towards[t]
            dnew = dh * (1 - update) * (1 - new * new)
            dinner = dnew * reset
            da = np.concatenate([dh * (h - new) * update * (1 - update), dnew * inner * reset * (1 - reset), dnew])
            dg = np.concatenate([da[: 2 * hidden], dinner])
            du += dg @ h.T
            db += dinner.sum(axis=1, keepdims=True)
            one = np.zeros((len(steps[t]), 256), dtype=np.float32)
            one[np.arange(len(one)), steps[t]] = 1
            dx += da @ one
            dh = dh * update + self.u.T @ dg
        return [dx, du, db]


def softmax(scores: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


class Network:
    """Two cells and one linear layer from both states of a byte to the languages."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back = Cell(hidden, rng), Cell(hidden, rng)
        self.w = (rng.normal(size=(len(languages), 2 * hidden)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.c = np.zeros((len(languages), 1), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.forth.parameters(), *self.back.parameters(), self.w, self.c]

    def loss_and_gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all bytes of ``windows`` (window, step), each labelled with its window's language."""
        steps = np.ascontiguousarray(windows.T)
        one, kept_one = self.forth.states(steps)
        other, kept_other = self.back.states(steps[::-1])
        other = other[::-1]
        both = np.concatenate([one, other], axis=1)
        p = softmax(self.w @ both + self.c, axis=1)
        at = np.arange(len(labels))
        loss = float(-np.log(np.maximum(p[:, labels, at], 1e-30)).mean())
        p[:, labels, at] -= 1
        p /= p.shape[0] * p.shape[2]
        hidden = one.shape[1]
        dw = np.einsum("tln,thn->lh", p, both, optimize=True)
        dboth = self.w.T @ p
        return loss, [
            *self.forth.gradients(steps, kept_one, dboth[:, :hidden]), *self.back.gradients(steps[::-1], kept_other, dboth[::-1, hidden:]),
            dw, p.sum(axis=(0, 2))[:, None],
        ]

    def fit(self, windows: np.ndarray, labels: np.ndarray, shown: int = SHOWN, seed: int = 12) -> list[float]:
        """Adam over shuffled batches, languages in equal shares; the rate falls to zero. Returns the losses."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        groups = [g for g in groups if len(g)]
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        rounds = max(1, shown // BATCH)
        losses = []
        for k in range(rounds):
            own = np.concatenate([rng.choice(g, size=-(-BATCH // len(groups))) for g in groups])
            loss, gradients = self.loss_and_gradients(windows[own], labels[own])
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in gradients)))
            rate = RATE * (1 - k / rounds) * np.sqrt(1 - DECAY2 ** (k + 1)) / (1 - DECAY1 ** (k + 1))
            for p, g, m, v in zip(self.parameters(), gradients, first, second, strict=True):
                g = g * np.float32(min(1.0, MAX_NORM / (norm + 1e-12)))
                m += (1 - DECAY1) * (g - m)
                v += (1 - DECAY2) * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """(step, language, window) scores of every byte of ``windows`` (window, step); no more is kept of either direction."""
        steps = np.ascontiguousarray(windows.T)
        hidden = self.w.shape[1] // 2
        out = np.empty((len(steps), len(self.languages), steps.shape[1]), dtype=np.float32)
        for cell, w, order in ((self.forth, self.w[:, :hidden], range(len(steps))), (self.back, self.w[:, hidden:], range(len(steps) - 1, -1, -1))):
            half = np.concatenate([np.full(2 * hidden, 0.5), np.ones(hidden)]).astype(np.float32)[:, None]
            by_byte, u = cell.x * half, cell.u * half
            h = np.zeros((hidden, steps.shape[1]), dtype=np.float32)
            a, g = (np.empty((3 * hidden, steps.shape[1]), dtype=np.float32) for _ in range(2))
            for t in order:
                np.take(by_byte, steps[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                gates = g[: 2 * hidden]
                gates += a[: 2 * hidden]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new = g[2 * hidden :]
                new += cell.b
                new *= gates[hidden:]
                new += a[2 * hidden :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:hidden]
                h += new
                if cell is self.forth:
                    np.matmul(w, h, out=out[t])
                else:
                    out[t] += w @ h
        out += self.c
        return out


def cut(data: bytes, steps: int = STEPS) -> tuple[np.ndarray, int]:
    """Windows (window, step) that cover all bytes, and how many places at the start of the last one do not count."""
    whole = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    n = len(whole)
    if n < steps:
        return np.concatenate([np.full(steps - n, SPACE, dtype=np.uint8), whole])[None], steps - n
    full, rest = divmod(n, steps)
    windows = whole[: full * steps].reshape(full, steps)
    if rest:
        windows = np.concatenate([windows, whole[None, n - steps :]])
    return windows, steps - rest if rest else 0


def labelled(network: Network, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sum over its bytes of the logarithms of their distributions, and how many bytes each language labels."""
    if not texts:
        return []
    cuts = [cut(t) for t in texts]
    windows = np.concatenate([w for w, _ in cuts])
    ends = np.cumsum([len(w) for w, _ in cuts])
    skipped = np.zeros(len(windows), dtype=np.int64)
    skipped[ends - 1] = [s for _, s in cuts]
    languages = len(network.languages)
    logs, counts = np.zeros((languages, len(windows))), np.zeros((languages, len(windows)), dtype=np.int64)
    for at in range(0, len(windows), TOGETHER):
        part = slice(at, at + TOGETHER)
        scores = network.logits(windows[part])
        scores -= scores.max(axis=1, keepdims=True)
        best = scores == 0
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        short = np.flatnonzero(skipped[part])
        for w in short.tolist():
            scores[: skipped[at + w], :, w] = 0
            best[: skipped[at + w], :, w] = False
        logs[:, part] = scores.sum(axis=0, dtype=np.float64)
        counts[:, part] = best.sum(axis=0)
    starts = np.concatenate(([0], ends[:-1]))
    return list(zip(np.add.reduceat(logs, starts, axis=1).T, np.add.reduceat(counts, starts, axis=1).T, strict=True))


def _windows_of(batches):
    """Some windows of each text, at places that a hash of the text tells."""
    for batch in slices(batches, "text"):
        langs, windows = [], []
        for text, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "lang")), strict=True):
            if not has_letter(text):
                continue
            data = text.encode()
            rng = np.random.default_rng(xxhash.xxh64_intdigest(data))
            own = cut(data)[0] if len(data) <= STEPS else np.stack([
                _FOLD[np.frombuffer(data[x : x + STEPS], dtype=np.uint8)] for x in rng.integers(0, len(data) - STEPS + 1, size=min(TRAIN_WINDOWS, -(-len(data) // STEPS))).tolist()
            ])
            langs += [lang] * len(own)
            windows += [w.tobytes() for w in own]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_DOCS, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text) of up to ``rows`` documents of each language: those with the smallest hashes of their ids, held-out ones excepted.

    Languages are counted first, and rows whose hash lies far above what is needed do not reach the ranking, so no task meets a whole language.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        (remainder(F.col("id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    keyed = own.select("lang", "id", F.xxhash64("text").alias("content"), place.alias("place"))
    near = keyed.join(F.broadcast(counts), "lang").where(F.col("place") <= F.lit(float(1 << 40)) * (3 * rows + 50) / F.col("n"))
    order = W.partitionBy("lang").orderBy("place", "id", "content")
    chosen = near.select("lang", "id", "content", "place", F.row_number().over(order).alias("k")).where(F.col("k") <= rows).select(
        F.col("lang").alias("l"), F.col("id").alias("i"), F.col("content").alias("c")
    ).distinct()
    match = F.col("id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("c"))
    # at most rows * languages keys; a document that is repeated as a whole is learnt from once
    return own.join(F.broadcast(chosen), match).select("lang", "text", "i", "c").dropDuplicates(["lang", "i", "c"]).select("lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_DOCS, shown: int = SHOWN) -> Network:
    """The network for the languages of the documents that are not held out; without any it knows none."""
    found = stage(sample(docs, id_col, text_col, lang_col, rows).mapInArrow(_windows_of, "lang string, window binary")).toArrow()
    # sorted, so that the network does not depend on the order of tasks; a bounded number, see above
    pairs = sorted(zip(found.column("lang").to_pylist(), found.column("window").to_pylist(), strict=True))
    network = Network(sorted({lang for lang, _ in pairs}))
    if len(network.languages) > 1:
        number = {lang: k for k, lang in enumerate(network.languages)}
        network.fit(np.frombuffer(b"".join(w for _, w in pairs), dtype=np.uint8).reshape(-1, STEPS), np.array([number[lang] for lang, _ in pairs]), shown)
    return network


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, ``bytes_by_language``.

    ``score`` is the document's probability of the predicted language, ``bytes_by_language`` how many bytes of the text each language labels. Null
    texts, texts without a letter and all texts if no language was learnt are ``und`` with score 0 and no labels. With one language learnt every
    other text is of that one. Null ids stay null and are not held out; repeated rows are kept; other columns, also ones named like results, are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.map_(pa.string(), pa.int64())

    def judged(batches):
        network = shared.value
        names = network.languages
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if names and has_letter(t)]
            pred, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            for i, (logs, counts) in zip(some, labelled(network, [texts[i].encode() for i in some]), strict=True):
                p = softmax(logs / max(int(counts.sum()), 1), axis=0)
                best = int(p.argmax())
                pred[i], score[i], shares[i] = names[best], float(p[best]), [(n, int(c)) for n, c in zip(names, counts, strict=True) if c]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind)],
                names=["doc_id", "held_out", "lang_pred", "score", "bytes_by_language"],
            )

    return rows.mapInArrow(judged, "doc_id long, held_out boolean, lang_pred string, score double, bytes_by_language map<string,long>")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out and identifies all; see ``train`` and ``identify``."""
    return identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
