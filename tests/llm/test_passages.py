"""Repeated passages of over fifty words in the pipeline's stage, however short their words are."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from flowgate.llm import suffixes


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 4) for _ in range(n)]


def documents():
    short, long, fifty = words(55, 1), words(300, 2), words(50, 3)
    r = random.Random(4)
    out = [words(r.randint(0, 90), 100 + i) + passage + words(r.randint(0, 90), 200 + i) for i, passage in enumerate([short, short, short[:52], long, long[40:], long[:200], fifty, fifty, short, words(80, 5)])]
    return [(i, (" " if i % 2 else "\n ").join(x)) for i, x in enumerate(out)] + [(20, ""), (21, None), (22, "é" * 450), (23, "x" + "é" * 450)]


def plain_kept(texts, n=51):
    """Words that are in no repeated string of 51 words or of 400 bytes."""
    seen = Counter(tuple(w[k : k + n]) for _, t in texts for w in [(t or "").split()] for k in range(len(w) - n + 1))
    strings = Counter(d[k : k + 400] for _, t in texts for d in [(t or "").encode()] for k in range(len(d) - 399))
    out = {}
    for i, t in texts:
        own = (t or "").split()
        gone = {j for k in range(len(own) - n + 1) if seen[tuple(own[k : k + n])] > 1 for j in range(k, k + n)}
        if any(strings[(t or "").encode()[k : k + 400]] > 1 for k in range(len((t or "").encode()) - 399)):
            continue
        out[i] = [w for j, w in enumerate(own) if j not in gone]
    return out


def test_passages_go(spark, sf, monkeypatch):
    texts = documents()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars long")
    wanted = plain_kept(texts)
    assert len(wanted[0]) < len(texts[0][1].split()) and len(wanted[6]) == len(texts[6][1].split()) and len(texts[0][1]) > 0
    for few in (48, 1):
        monkeypatch.setattr(suffixes, "FEW", few)
        got = {r.doc_id: (r.text or "").split() for r in corpus_pipeline.repeated_strings(spark, df, sf).collect()}
        assert {i: got[i] for i in wanted} == wanted
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(df, many=1, rules=(suffixes.PASSAGES,)).collect()}
    assert {i: (got[i] or "").split() for i in wanted if i < 20} == {i: x for i, x in wanted.items() if i < 20}


def test_strings_of_400_bytes_still_go(spark, sf):
    texts = documents()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, df, sf).where("doc_id > 20").collect()}
    assert got == {21: None, 22: "", 23: "x"}


def test_passages_are_reported(spark):
    texts = documents()
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    seen = Counter(tuple(w[k : k + 51]) for _, t in texts for w in [(t or "").split()] for k in range(len(w) - 50))
    for r in suffixes.dedup(df).collect():
        own = (dict(texts)[r.doc_id] or "").split()
        hit = [False] * len(own)
        for k in range(len(own) - 50):
            if seen[tuple(own[k : k + 51])] > 1:
                hit[k : k + 51] = [True] * 51
        assert r.n_passage_words == sum(hit) and r.n_passages == sum(a and not b for a, b in zip(hit, [False, *hit]))
