"""Periodic runs against the definition: every period tried at every place."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from flowgate.llm import periodic, queries
from flowgate.llm.common import table


def plain_runs(words, shortest=24, periods=3):
    """Smallest period of each maximal stretch that is long enough."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        same = [a == b for a, b in zip(words, words[q:])]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j - i + q >= max(shortest, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    start, length, period = best or (None, None, None)
    return len(found), start, length, period, best and 1000 * length // period, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest()


def plain_tail(words, doc):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(150):
        n, kinds = r.randint(0, 110), r.choice([1, 2, 3, 6, 40])
        words = [str(r.randint(0, kinds)).encode() for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n:
                a, p = r.randrange(n), r.randint(1, 12)
                block = (words[a : a + p] * 40)[: r.randint(0, n - a)]
                words[a : a + len(block)] = block
        limits = r.choice([(24, 3), (6, 3), (10, 3), (6, 2)])
        assert [tuple(x) for x in periodic.runs(words, *limits).tolist()] == plain_runs(words, *limits)


def test_tree_answers_common_extensions():
    r = random.Random(8)
    for n, kinds in ((1, 1), (2, 1), (40, 1), (90, 2), (200, 5)):
        text = [r.randint(1, kinds) for _ in range(n)]
        tree = periodic.SuffixTree(text)
        tree.tour()
        ended = [*text, 0]
        assert tree.suffixes.tolist() == sorted(range(n + 1), key=lambda i: ended[i:])
        falling = [-x for x in text] + [-10**6]
        assert np.argsort(tree.falling_rank()).tolist() == sorted(range(n + 1), key=lambda i: falling[i:])
        pairs = [(r.randrange(n + 1), r.randrange(n + 1)) for _ in range(60)]
        pairs = [(a, b) for a, b in pairs if a != b]
        if pairs:
            wanted = [next(k for k in range(n + 1) if ended[a + k] != ended[b + k]) for a, b in pairs]
            assert tree.common(*map(np.array, zip(*pairs))).tolist() == wanted


def test_lyndon_ends():
    r = random.Random(3)
    for _ in range(40):
        text = [r.randint(1, 3) for _ in range(r.randint(1, 30))]
        tree = periodic.SuffixTree(text)
        tree.tour()
        lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
        ends = periodic.lyndon_ends(tree.rank[: len(text)]).tolist()
        assert ends == [max(j for j in range(i + 1, len(text) + 1) if lyndon(text[i:j])) for i in range(len(text))]


def test_query_on_the_table(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf).collect()}
    rows = table(spark, sf, "documents").collect()
    assert len(got) == len(rows) and any(v[0] for v in got.values())
    for r in rows:
        words = (r.text or "").encode().split()
        if len(words) < 900:  # the plain version is quadratic; the SQL twin covers all
            assert got[r.doc_id] == plain_row(plain_tail(words, r.doc_id))


def test_odd_rows(spark):
    long = " ".join(map(str, range(300))) + " tail" + " a b c" * 30_000
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "x " * 24), (5, "x " * 24), (6, "x " * 23), (None, "y z " * 12), (7, "  " * 30), (8, long), (9, "p q r s t u v w " * 3)]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in texts], "doc_id long, text string, n_runs int, runs string, period int").repartition(4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic.periodic_runs(df).collect())
    assert got == [
        (-1, 1, 0, 24, 2, 12000), (1, 0, None, None, None, None), (2, 0, None, None, None, None), (3, 0, None, None, None, None), (4, 0, None, None, None, None),
        (5, 1, 0, 24, 1, 24000), (5, 1, 0, 24, 1, 24000), (6, 0, None, None, None, None), (7, 1, 0, 30, 1, 30000), (8, 1, 301, 90000, 3, 30000000), (9, 1, 0, 24, 8, 3000),
    ]
    collapsed = {r.doc_id: r.collapsed for r in periodic.periodic_runs(df).collect()}
    assert collapsed[9] == "p q r s t u v w" and collapsed[8].endswith("tail a b c") and collapsed[1] == ""
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert periodic.repeating_tail([], 5) == [] and periodic.repeating_tail([b"a"], None) == [b"a"]
