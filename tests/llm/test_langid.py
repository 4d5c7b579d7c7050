"""The network's gradients against differences, its reading against the training pass, and held-out accuracy."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from flowgate.llm import langid, queries
from flowgate.llm.common import table


def test_gradients():
    network = langid.Network(["a", "b", "c"], hidden=4)
    for owner, names in ((network.forth, "xub"), (network.back, "xub"), (network, "wc")):
        for name in names:
            setattr(owner, name, getattr(owner, name).astype(np.float64))
    r = np.random.default_rng(0)
    windows, labels = r.integers(0, 5, size=(6, 9)).astype(np.uint8), r.integers(0, 3, size=6)
    _, gradients = network.loss_and_gradients(windows, labels)
    for p, g in zip(network.parameters(), gradients):
        assert p.shape == g.shape
        for _ in range(8):
            at = (int(r.integers(0, p.shape[0])), int(r.integers(0, min(p.shape[1], 5))))
            kept, losses = p[at], []
            for step in (0.01, -0.01):
                p[at] = kept + step
                losses.append(network.loss_and_gradients(windows, labels)[0])
            p[at] = kept
            assert (losses[0] - losses[1]) / 0.02 == pytest.approx(g[at], abs=2e-4)


def test_reading_equals_the_training_pass_and_every_byte_is_labelled():
    network = langid.Network(["a", "b"], hidden=5)
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, size=n).astype(np.uint8)) for n in (1, 63, 64, 65, 128, 5000, 64 * 2100)]
    for text, (logs, counts) in zip(texts, langid.labelled(network, texts)):
        assert counts.sum() == len(text)
        windows, skipped = langid.cut(text)
        steps = np.ascontiguousarray(windows.T)
        both = np.concatenate([network.forth.states(steps)[0], network.back.states(steps[::-1])[0][::-1]], axis=1)
        p = np.log(langid.softmax(network.w @ both + network.c, axis=1))
        p[:skipped, :, -1] = 0
        assert np.allclose(p.sum(axis=(0, 2)), logs, rtol=1e-3)
    assert langid.labelled(network, []) == []


def test_held_out_accuracy(spark, sf):
    rows = {r.doc_id: (r.text, r.lang) for r in table(spark, sf, "documents").collect()}
    got = queries.op11_language_id(spark, sf).collect()
    assert len(got) == len(rows)
    right = []
    for r in got:
        text, lang = rows[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not langid.has_letter(text):
            assert r.lang_pred == "und"
        elif r.held_out and lang:
            right.append(r.lang_pred == lang)
    assert sum(right) >= 0.95 * len(right)


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, sf):
    docs = table(spark, sf, "documents")
    lied = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'xx' ELSE lang END AS lang", "lang AS source", "1 AS score")
    a, b = (Counter((r.doc_id, r.lang_pred, r.score) for r in langid.identify(d, langid.train(d, shown=1000)).collect()) for d in (docs, lied.repartition(6)))
    assert a == b and "xx" not in {x[1] for x in a}


def test_odd_rows(spark):
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1)
    null, empty, digits, en, fr, long, odd = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:7]
    texts = [(null, None, "en"), (empty, "", "en"), (digits, " 12 !?", "fr"), (en, "the cat and the dog " * 9, "en"), (en, "the cat and the dog " * 9, "en"), (fr, "le chat et le chien " * 9, "fr"), (None, "le chat", None),
             (held, "the dog", None), (long, "le chat et le chien " * 20_000, "fr"), (odd, "\U0001d400" * 9, None)]
    df = spark.createDataFrame([(i, t, lang, "s", 1, True) for i, t, lang in texts], "doc_id long, text string, lang string, lang_pred string, score int, held_out boolean").repartition(3)
    got = Counter((r.doc_id, r.held_out, r.lang_pred, sum(r.bytes_by_language.values())) for r in langid.languages(df).collect())
    size = {i: len((t or "").encode()) for i, t, _ in texts}
    named = {(k[0], k[2]) for k in got}
    assert {(null, "und"), (empty, "und"), (digits, "und"), (en, "en"), (fr, "fr"), (long, "fr")} <= named and got[en, False, "en", size[en]] == 2 and sum(got.values()) == len(texts)
    assert all(k[3] == (0 if k[2] == "und" else size[k[0]]) for k in got) and {k[0] for k in got if k[1]} == {i for i, _, _ in texts if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert langid.languages(df.limit(0)).count() == 0
    none = langid.languages(df.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}
    one = langid.languages(df.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in one} == {"und", "en"}
