"""Near duplicates of the pipeline against plain five-word similarity."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np

import corpus_pipeline
from flowgate.llm import simhash, similar


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def plain_kept(texts):
    sets, root = [plain_set(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for k, (i, _) in enumerate(texts):
        least.setdefault(find(k), []).append(i)
    return Counter(min((i for i in v if i is not None), default=None) for v in least.values())


def edited():
    """Originals and copies with words replaced, at similarities around 0.8; odd texts; a chain of ever further copies."""
    r = random.Random(31)
    word = lambda: f"w{r.randint(0, 3000)}"
    texts = [None, "", " \n", "One two", "one  TWO", "one two three", "a b c d e", "a b c d e f"]
    for edits in [0, 1, 2, 3, 3, 4, 4, 4, 5, 6, 9] * 3:
        base = [word() for _ in range(200)]
        copy = list(base)
        for at in r.sample(range(200), edits):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy).upper()]
    chain = [word() for _ in range(300)]
    for k in range(20):
        texts.append(" ".join(chain))
        chain[13 * k : 13 * k + 10] = [word() for _ in range(10)]
    return [*enumerate(texts), (None, texts[8]), (None, "alone " * 7), (8, texts[8])]


def test_edited_copies_go(spark, sf):
    texts = edited()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, df, sf)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == plain_kept(texts)
    assert similar.keep_one(df.limit(0)).count() == 0
    assert any((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4 and len(plain_set(a) & plain_set(b)) >= 0.8 * len(plain_set(a) | plain_set(b)) for (_, a), (_, b) in combinations(texts[:80], 2))


def test_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    texts = edited()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(r.doc_id for r in similar.keep_one(df).collect()) == plain_kept(texts)


def test_many_texts_just_below_the_threshold_give_few_rows():
    """4,000 texts that all are candidates of each other: at most one pair for each in the first pass and one bridge for each in the second."""
    r = np.random.default_rng(0)
    base = r.integers(0, 256, 150)
    sketches = np.where(r.random((4000, 150)) < 0.87, base, r.integers(0, 256, (4000, 150))).astype(np.uint8)
    assert len(similar.likely_pairs(sketches)) < 4000 and similar.bridges(sketches, np.zeros(4000)) == []
    assert len(similar.bridges(sketches, np.arange(4000))) == 3999


def plain_roots(n, edges):
    root = list(range(n))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if z in (x, y) else z for z in root]
    return root


def test_bridges_connect_all_candidates_between_components():
    r = np.random.default_rng(4)
    for n in (2, 9, 40):
        bases = r.integers(0, 256, (3, 150))
        sketches = np.where(r.random((n, 150)) < 0.8, bases[r.integers(0, 3, n)], r.integers(0, 256, (n, 150))).astype(np.uint8)
        roots = r.integers(0, 4, n)
        wanted = [(a, b) for a in range(n) for b in range(a) if roots[a] != roots[b] and (sketches[a] == sketches[b]).mean() >= similar.MAYBE]
        found = similar.bridges(sketches, roots)
        assert {tuple(sorted(x, reverse=True)) for x in found} <= set(wanted) and plain_roots(n, found) == plain_roots(n, wanted)


def test_links_between_components_are_complete():
    r = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([np.arange(60, dtype=np.uint64) * 7 + 1000 * (i % 3), r.integers(10**6, 10**9, int(r.integers(0, 18))).astype(np.uint64)])) for i in range(40)]
    sketches = np.stack([np.frombuffer(similar.sketch_of(similar.minima(s)), dtype=np.uint8) for s in sets])
    roots = [i // 2 for i in range(40)]
    given = [(2 * i, 2 * i + 1) for i in range(20)]
    found = similar.links_between(sketches, roots, sets)
    assert all(similar.similar(sets[a], sets[b]) for a, b in found)
    wanted = [(a, b) for a in range(40) for b in range(a) if similar.similar(sets[a], sets[b])]
    assert plain_roots(40, given + found) == plain_roots(40, given + wanted)


def test_clusters_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL", 4)
    texts = edited()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(r.doc_id for r in similar.keep_one(df).collect()) == plain_kept(texts)


def test_postings_are_the_positional_bytes():
    """Texts meet in a band exactly where all its positional bytes are equal, whatever the minima behind them are."""
    r = np.random.default_rng(5)
    least = [r.integers(0, 1 << 63, size=similar.ROWS * similar.BANDS, dtype=np.uint64) for _ in range(2)]
    own = [np.frombuffer(similar.sketch_of(x), dtype=np.uint8) for x in least]
    # the second text gets minima of the same bytes in the first ten bands, but other ones
    for i in range(10 * similar.ROWS):
        while similar.sketch_of(least[1][i : i + 1]) != similar.sketch_of(least[0][i : i + 1]):
            least[1][i] += np.uint64(1 << 40)
    own[1] = np.frombuffer(similar.sketch_of(least[1]), dtype=np.uint8)
    equal = (own[0] == own[1]).reshape(similar.BANDS, similar.ROWS).all(axis=1)
    keys = [similar.keys_of(x) for x in least]
    assert equal.sum() >= 10 and ((keys[0] == keys[1]) == equal).all()
    assert len(set(keys[0].tolist())) == similar.BANDS and (keys[0] >> 8 * similar.ROWS == np.arange(similar.BANDS)).all()


def test_fingerprints_link_texts_that_share_no_posting(spark):
    """SimHash fingerprints of at most four differing bits are a way of their own to a link, which is verified all the same."""
    r = random.Random(8)
    words = [f"w{r.randint(0, 3000)}" for _ in range(300)]
    copies = [" ".join([*words[:i], "new", *words[i + 1 :]]) for i in range(20, 280, 20)]
    near = next(t for t in copies if (simhash.fingerprint(t, 5) ^ simhash.fingerprint(" ".join(words), 5)).bit_count() in (1, 2, 3, 4))
    texts = [" ".join(words), near, "something else " * 30, "once more"]
    fp = lambda t: int(np.array(simhash.fingerprint(t, 5), dtype=np.uint64).view(np.int64))
    sketch = lambda t: similar.sketch_of(similar.minima(similar.shingles(t)))
    # the third text has the fingerprint of the first one, but is not similar to it
    rows = spark.createDataFrame([(i, [i], bytearray(sketch(t)), fp(texts[0] if i == 2 else t)) for i, t in enumerate(texts)], "content long, keys array<long>, sketch binary, fp long")
    found = similar.links(rows, spark.createDataFrame(list(enumerate(texts)), "content long, text string"))
    assert {(x.a, x.b) for x in found.collect()} == {(0, 1)}
