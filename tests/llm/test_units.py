"""Parts of the operators against plain versions, without Spark."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from flowgate.llm import decontam, labelled, packing, pagetext, quality, sharding, simhash, suffixes, tokens, toxicity, warc

ODD = [None, "", " ", "\n", "a", "a b c", " a", "a ", "a  b", "a \nb", "a\n b", "É é ÀÉ", "x y  z", "日本語 テスト", "a" * 5000, "<|endoftext|> x", "it's 12,5 €\r\n"]


def texts(n=40, seed=1):
    rng = random.Random(seed)
    words = ["the", "idiot", "straße", "co-op", "x1", "Été", "of", "|", "##", "12"]
    return ODD + [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.randint(1, 200))) for _ in range(n)]


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe(*tokens.installed_bpe(), tokens.installed_added())


def test_ids_equal_the_tokenizers_file(bpe):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts():
        assert bpe.encode(text).tolist() == reference.encode(text or "", add_special_tokens=False).ids


def test_token_lengths_cover_the_text(bpe):
    for text in texts():
        assert bpe.lengths[bpe.encode(text)].sum() == len((text or "").encode())


@pytest.mark.parametrize("rule", tokens.RULES)
def test_allocation(rule):
    lengths, starts, total = np.array([3, 4, 5, 2]), np.array([0, 4, 5, 9]), 14
    owner = [0] * 4 + [1] + [2] * 4 + [3] * 5
    wanted, crossing, at = [0.0] * 4, [0] * 4, 0
    for n in lengths.tolist():
        own = owner[at : at + n]
        at += n
        parts = Counter(own)
        if rule == "share":
            for k, v in parts.items():
                wanted[k] += v / n
                crossing[k] += len(parts) > 1
        else:
            k = own[0] if rule == "first" else min(parts, key=lambda k: (-parts[k], k))
            wanted[k] += 1
            crossing[k] += len(parts) > 1
    counts, crosses = tokens.allocate(lengths, starts, total, rule)
    assert counts.tolist() == pytest.approx(wanted) and crosses.tolist() == crossing and counts.sum() == pytest.approx(4)


# ---------------------------------------------------------------- packing

def test_fill_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        used = packing.fill(dict(counts), room)
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room) if len(items) <= 12 else None
        assert all(counts[n] >= k for n, k in used.items())
        assert best is None or sum(n * k for n, k in used.items()) == best


@pytest.mark.parametrize("lengths", [[], [7], [600] * 30, [1] * 5000, [1023, 1, 512, 512, 511], list(range(1, 1024)) * 2, [333] * 100 + [700] * 50])
def test_plan_places_every_token_once(lengths):
    plan = packing.Plan(dict(Counter(lengths)), 1024)
    bins: dict[int, list] = {}
    for length, count in Counter(lengths).items():
        for rank in range(count):
            pieces = plan.place(length, rank)
            assert sum(n for _, _, n in pieces) == length
            for b, at, n in pieces:
                bins.setdefault(b, []).append((at, n))
    full = 0
    for pieces in bins.values():
        at = 0
        for begin, n in sorted(pieces):
            assert begin == at
            at += n
        assert at <= 1024
        full += at == 1024
    assert len(bins) == plan.bins and full >= plan.bins - 1


# ---------------------------------------------------------------- fingerprints

def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    for text in [*texts(), " ".join(str(i % 977) for i in range(70_000))]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_positions_meet_every_four_bytes():
    family = [set(t) for t in simhash.position_family()]
    assert len(family) == 20 and all(any(t <= set(c) for t in family) for c in combinations(range(8), 4))


def test_forest_connects_what_links_connect():
    rng = random.Random(5)
    for _ in range(30):
        base = [rng.getrandbits(64) for _ in range(4)]
        fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(15)})

        def parts(edges, fps=fps):
            root = {x: x for x in fps}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[find(a)] = find(b)
            return sorted(sorted(x for x in fps if find(x) == r) for r in {find(x) for x in fps})

        links = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4]
        edges = simhash.forest(np.array(fps, dtype=np.uint64))
        assert parts(links) == parts(edges) and len(edges) < len(fps)


# ---------------------------------------------------------------- decontamination

def test_matcher_equals_plain_search():
    rng = random.Random(7)
    for _ in range(60):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for i in range(4)]
        matcher = decontam.Matcher(items, 4)
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        hit, found = [0] * len(words), set()
        for item, text in items:
            own = text.split()
            size = min(4, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit[j : j + size] = [1] * size
                        found.add(item)
        n, runs, names = matcher.search(" ".join(words))
        assert n == len(words) and names == sorted(found)
        assert [i for b, e in zip(runs[::2], runs[1::2], strict=True) for i in range(b, e)] == [i for i, h in enumerate(hit) if h]


def test_words_are_folded():
    assert decontam.words_of("Été ABC-d9_e ß") == ["Été".encode(), b"abc", b"d9", "e ß".encode()]


# ---------------------------------------------------------------- suffixes

def test_every_string_start_has_one_anchor(monkeypatch):
    rng = random.Random(11)
    for data in (b"", b"x" * 399, b"x" * 3000, bytes(rng.choice(b"abcdef ") for _ in range(5000))):
        for chunk in (1 << 18, 700):
            monkeypatch.setattr(suffixes, "CHUNK", chunk)
            suffixes._fingerprint_tables.cache_clear()
            pos, before, after, *_ = suffixes.anchors_of(data)
            starts = sorted(s for p, b, a in zip(pos, before, after, strict=True) for s in range(p - b, p + a - 400 + 1))
            assert starts == list(range(max(0, len(data) - 399)))
    suffixes._fingerprint_tables.cache_clear()


def test_equal_strings_have_equal_anchors():
    rng = random.Random(13)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(400))
    places = set()
    for _ in range(10):
        head, tail = (bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 900))) for _ in range(2))
        pos, before, after, key, *_ = suffixes.anchors_of(head + passage + tail)
        s = len(head)
        places |= {(p - s, k) for p, b, a, k in zip(pos.tolist(), before.tolist(), after.tolist(), key.tolist(), strict=True) if p - b <= s <= p + a - 400}
    assert len(places) == 1


# ---------------------------------------------------------------- sharding

def test_differencing_balances_and_covers():
    rng = np.random.default_rng(1)
    sizes = rng.integers(16, 5000, 2000)
    parts = np.zeros((2000, 40), dtype=np.int64)
    parts[:, 0] = sizes
    to = sharding.difference(parts)
    assert all(sorted(row) == list(range(40)) for row in to.tolist())
    loads = np.bincount(to[:, 0], sizes, minlength=40)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 16
    assert sharding.difference(parts[:0]).shape == (0, 40) and sharding.difference(parts[:1])[0, 0] in range(40)


# ---------------------------------------------------------------- toxicity and quality

def test_segments_are_the_maximal_ones():
    """Each found segment's every proper prefix and suffix is positive, and no union with what follows is better."""
    def slow(scores):
        # take the best segment (the shortest of equal ones), then do the same to its left and right
        best = None
        for i in range(len(scores)):
            for j in range(i + 1, len(scores) + 1):
                s = round(sum(scores[i:j]), 9)
                if s > 0 and (best is None or (s, i - j) > (best[2], best[0] - best[1])):
                    best = (i, j, s)
        if best is None:
            return []
        i, j, _ = best
        return slow(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in slow(scores[j:])]

    rng = random.Random(17)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1.5, -1, 0.5, 1.25, 2.125, 3.0625]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        assert [(a, b, pytest.approx(s)) for a, b, s in slow(scores)] == toxicity.segments(np.array(scores, dtype=float))


def test_base_counts():
    for text in [*texts(), "a b c d e a b c d e x\nq\nq\n\n \nq", "To " * 30, " ".join(f"w{i}" for i in range(30_000)) + "z" * 70_000 + " ab"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        marks = [0] * len(words)
        for i in range(len(words) - 4):
            if grams[tuple(words[i : i + 5])] > 1:
                marks[i : i + 5] = [1] * 5
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(marks))
        assert quality.Text(text).counts() == wanted


def test_calibration_is_monotone_and_finite():
    a, b = labelled.calibrate(np.array([0.0, 1, 2, 3]), np.array([0.0, 0, 1, 1]), np.ones(4))
    assert a > 0 and 0 < labelled.logistic(np.array(a * 0 + b)) < 0.5 < labelled.logistic(np.array(a * 3 + b)) < 1
    assert np.isfinite(labelled.calibrate(np.zeros(0), np.zeros(0), np.zeros(0))).all()


# ---------------------------------------------------------------- pages and archives

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>First  line<br><p>Second&nbsp;&lt;x&gt; <i>em</i>phasis</p><script>var t="</p>";</script>
<div id="comments"><p>Nice!</p></div></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_blocks_of_a_page():
    lines, regions = pagetext.lines_of(PAGE)
    assert [x for x, r in zip(lines, regions, strict=True) if r == pagetext.MAIN] == ["Title & more", "First line", "Second <x> emphasis"]
    assert {x for x, r in zip(lines, regions, strict=True) if r == pagetext.NEVER} == {"Menu", "Buy", "Nice!", "Side", "© me"}
    assert pagetext.lines_of(None) == ([], []) == pagetext.lines_of("")
    for cut in range(len(PAGE)):
        pagetext.lines_of(PAGE[:cut])


def test_shared_lines_are_a_longest_common_subsequence():
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(19)
    for _ in range(1000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        own = [x for x, s in zip(a, pagetext.shared_lines(a, b), strict=True) if s]
        rest = iter(b)
        assert len(own) == lcs(a, b) and all(x in rest for x in own)


def test_loser_tree_merges():
    rng = random.Random(23)
    for k in (0, 1, 2, 3, 7, 16):
        runs = []
        for r in range(k):
            rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice([None, 1, 2]), 0, "", "", None, str(r), i, 0) for i in range(rng.randint(0, 20))]
            runs.append(sorted(rows, key=warc._order))
        got = list(warc.merged(runs))
        assert Counter(got) == Counter(x for run in runs for x in run)
        assert list(map(warc._order, got)) == sorted(map(warc._order, got))


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A/b?x=1#top") == "com,example)/a/b?x=1" == warc.url_key("https://example.com/A/b?x=1")
    assert warc.url_key("") == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_damaged_archives_raise():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(at, n, block) for at, n, _, block in warc.records(good * 2)] == [(0, len(good), b"abc"), (len(good), len(good), b"abc")]
    for bad in (b"x" + good, good[:-5], good[:-1]):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_digest_of_items():
    assert decontam.items_digest(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()


def test_both_ways_to_settle_agree(monkeypatch):
    rng = random.Random(29)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(450))
    entries: dict = {}
    for doc in range(40):
        head, tail = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(2))
        data = head + passage[rng.randint(0, 30) : rng.randint(415, 450)] + tail
        pos, before, after, key, *_ = suffixes.anchors_of(data)
        for p, b, a, k in zip(pos.tolist(), before.tolist(), after.tolist(), key.tolist(), strict=True):
            entries.setdefault(k, []).append((True, doc, 0, p, b, data[p - b : p + a]))
    found = []
    for few in (1000, 1):
        monkeypatch.setattr(suffixes, "FEW", few)
        found.append(sorted(s for group in entries.values() if len(group) > 1 for s in suffixes.settle(group)))
    assert found[0] == found[1] and len(found[0]) > 10
