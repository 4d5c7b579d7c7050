"""Operators on small tables against plain versions: nulls, empty and very long texts, ties, repeated rows, clashing columns, hot groups."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from flowgate.llm import components, decontam, packing, pagetext, quality, queries, sharding, simhash, suffixes, tokens, toxicity, warc
from flowgate.llm.common import table
from test_similar import plain_kept

CLASH = "doc_id long, text string, content int, runs string, spans int, items int, score string, row_id int, n_words int, n_chars long, lang string, source string"
rng = random.Random(4)
WORDS = [f"w{rng.randint(0, 900)}" for _ in range(700)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(120, 1)
TEXTS = [
    (1, None), (2, ""), (3, " \n "), (4, "one"), (5, prose(300, 2)), (5, prose(300, 2)), (6, prose(300, 2)), (None, prose(200, 3)), (None, prose(200, 3)), (None, None),
    (7, prose(80, 4) + " " + PASSAGE + " " + prose(50, 5)), (8, prose(30, 6) + " " + PASSAGE), (9, PASSAGE + " " + prose(90, 7)), (10, prose(60_000, 8)), (11, "é" * 900 + "x"),
    (12, "ab " * 700), (13, prose(20, 9) + " idiot " + prose(20, 10)), (14, PASSAGE[: len(PASSAGE) // 2] + " " + PASSAGE[len(PASSAGE) // 4 :]),
]
BENCH = [(1, " ".join(WORDS[:30])), (1, " ".join(WORDS[5:40])), (2, "one"), (3, None), (4, "!!"), (None, prose(15, 2)), (5, " ".join(prose(60_000, 8).split()[100:130]).upper())]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "r", 2, 3, "s", 4, 5, len(t or ""), "en", "src") for i, t in TEXTS]
    return spark.createDataFrame(rows, CLASH).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(1, 15)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def many(df):
    return Counter(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- 1 and 4: tokens and packing

def test_token_counts(odd, none):
    rows = tokens.token_counts(odd).collect()
    bpe = tokens.ByteBpe(*tokens.installed_bpe())
    wanted = Counter((i, len(bpe.encode(t))) for i, t in TEXTS)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.section == 0) == wanted
    assert sum(r.n_tokens for r in rows) == sum(n * c for (_, n), c in wanted.items())
    assert Counter((r.doc_id, r.end) for r in rows if r.section == 0 and r.doc_id in (1, 2, 4, 10)) == Counter({(1, 0): 1, (2, 0): 1, (4, 3): 1, (10, len(TEXTS[13][1])): 1})
    assert tokens.token_counts(none).count() == 0


def check_packing(pieces, texts, ids_kept):
    bpe = tokens.ByteBpe(*tokens.installed_bpe())
    ids = [(i, [*bpe.encode(t).tolist(), 0]) for i, t in texts]
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    totals = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        totals.append(at)
    assert max(totals, default=0) <= 1024 and sum(t < 1024 for t in totals) <= 1
    assert sum(r.length for r in pieces) == sum(len(x) for _, x in ids)
    whole = {}
    for i, x in ids:
        whole.setdefault(i, []).append(x)
    for r in pieces:
        options = [x[r.start : r.start + r.length] for x in whole[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x)) for x in options}
        if ids_kept:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for i, x in ids:
        own = Counter((r.start, r.length) for r in pieces if r.doc_id == i and r.doc_tokens == len(x))
        copies = sum(len(y) == len(x) for y in whole[i])
        assert sum(n * c for (_, n), c in own.items()) == copies * len(x)


def test_packing(odd, none):
    check_packing(packing.pack(odd).collect(), TEXTS, True)
    assert packing.pack(none).count() == 0


def test_packing_of_the_table(spark, sf):
    check_packing(queries.op4_packing(spark, sf).collect(), documents(spark, sf), False)


# ---------------------------------------------------------------- 2: decontamination

def plain_hits(texts, items, window=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns: dict = {}
    for item, text in items:
        words = fold(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            patterns.setdefault(tuple(words[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for i, t in texts:
        words = fold(t)
        hit, found = [0] * len(words), set()
        for n in {len(p) for p in patterns}:
            for j in range(len(words) - n + 1):
                if own := patterns.get(tuple(words[j : j + n])):
                    hit[j : j + n] = [1] * n
                    found |= own
        out.append((i, len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [4 << 20, 150])
def test_decontamination(odd, none, bench, block_bytes):
    got = many(decontam.hits(odd, bench, block_bytes=block_bytes).drop("runs", "items"))
    wanted = plain_hits(TEXTS, BENCH)
    assert got == wanted and sum(r[-1] for r in wanted) >= 4
    kept = decontam.clean(odd, bench, block_bytes=block_bytes)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in wanted.elements() if not r[-1])
    assert decontam.hits(none, bench, block_bytes=block_bytes).count() == 0
    assert many(decontam.hits(odd, bench.limit(0)).select("n_hit", "n_items")) == Counter({(0, 0): len(TEXTS)})


def test_decontamination_of_the_table(spark, sf):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert many(queries.op2_decontaminate(spark, sf)) == plain_hits(documents(spark, sf), items)


# ---------------------------------------------------------------- 3: repeated strings

def plain_removal(texts):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(d[k : k + 400] for _, d in data for k in range(len(d) - 399))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("limit", [suffixes.MANY, 1])
def test_repeated_strings(odd, none, limit):
    wanted = plain_removal([(i, t if len(t or "") < 50_000 else t) for i, t in TEXTS])
    assert many(suffixes.dedup(odd, many=limit).drop("kept", "n_passages", "n_passage_words")) == wanted
    if limit == 1:
        return
    kept = suffixes.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(TEXTS)
    assert {r.doc_id: r.text for r in kept.where("doc_id in (1, 2, 4, 5, 13)").collect()} == {1: None, 2: "", 4: "one", 5: "", 13: TEXTS[16][1]}
    assert suffixes.dedup(none).count() == 0


def test_crowded_beginnings(spark):
    """One passage in very many different surroundings, and near copies of one text, in each of the three ways."""
    r = random.Random(8)
    texts = [(i, prose(r.randint(5, 90), 100 + i) + PASSAGE + prose(r.randint(5, 90), 900 + i)) for i in range(60)]
    base = prose(400, 77).split()
    for i in range(60, 100):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(400)] = f"q{r.randint(0, 99)}"
        texts.append((i, " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for limit, few in ((suffixes.MANY, 1000), (suffixes.MANY, 5), (5, 5)):
        suffixes.FEW, kept = few, suffixes.FEW
        assert many(suffixes.dedup(df, many=limit).drop("kept", "n_passages", "n_passage_words")) == plain_removal(texts)
        suffixes.FEW = kept


def test_levels_grow_geometrically(spark):
    family = suffixes.LevelFamily()
    seen: Counter = Counter()
    for b in range(5):
        keys = [random.Random(b).randint(0, 30) for _ in range(25)]
        found = {r.key: r.n for r in family.add(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
        seen.update(keys)
        assert found == {k: seen[k] for k in set(keys) if seen[k] > 1}
    assert [rank for rank, _ in family.levels] == [2, 0]


def test_tables_of_a_rule_go_before_the_next_one(spark, monkeypatch):
    """When a rule starts, only the spans of the rules before it are left; the result needs nothing that is gone."""
    import os

    from flowgate.staging import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    r = random.Random(7)
    text = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(90))
    docs = spark.createDataFrame([(1, text), (2, f"a {text}"), (3, "short"), (None, None)], "doc_id long, text string")
    before, left, spans = set(os.listdir(folder)), [], suffixes.repeated_spans

    def seen(*args):
        left.append(len(set(os.listdir(folder)) - before))
        return spans(*args)

    monkeypatch.setattr(suffixes, "repeated_spans", seen)
    found = {x.doc_id: (x.n_spans, x.n_passages) for x in suffixes.dedup(docs).collect()}
    assert left == [0, 1] and found == {1: (1, 1), 2: (1, 1), 3: (0, 0), None: (0, 0)}


def test_levels_merge_when_a_batch_comes(spark, monkeypatch):
    """Nothing is merged behind the last batch, as no batch is scanned against it."""
    written, stage = [], suffixes.stage
    monkeypatch.setattr(suffixes, "stage", lambda df: written.append(1) or stage(df))
    family = suffixes.LevelFamily()
    for b in range(4):
        assert {r.key: r.n for r in family.add(spark.createDataFrame([(1,), (b + 2,)], "key long")).collect()} == ({1: b + 1} if b else {})
    # an array and its matches for each batch, and one merge before the third
    assert len(written) == 9


# ---------------------------------------------------------------- 5: archives

def test_archives(spark, none):
    rows = [(3, "http://a.org/x", "<p>1</p>"), (2, "http://a.org/x", "<p>1</p>"), (2, "http://a.org/x", "<p>1</p>"), (5, None, None), (4, "http://b.org\r\nX: y", ""), (None, "u", "<p>1</p>"), (None, "u", "n\r\n\r\nul é"), (9, "http://a.org/" + "y" * 3000, "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, time string").repartition(4)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    first: dict = {}
    for i, _, h in rows:
        first.setdefault(h or "", []).append(i)
    wanted: Counter = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        least = min((x for x in first[h or ""] if x is not None), default=None)
        again = least is not None and i != least
        wanted[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None] += 1
    assert got == wanted
    assert warc.archive(pages.limit(0)).count() == 0


def test_index_is_ordered(spark, sf):
    rows = [tuple(r) for r in warc.archive(table(spark, sf, "pages")).select("url_key", "time", "page_id").collect()]
    assert rows == sorted(rows) and len(rows) == table(spark, sf, "pages").count()


# ---------------------------------------------------------------- 6 and 9: verdicts

def test_quality(odd, none, labels):
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 12)) and all(0 <= r.probability <= 1 for r in rows)
    assert quality.judge(none, labels).count() == 0 and quality.judge(odd, labels.limit(0)).count() == len(TEXTS)


def test_quality_tells_junk(spark):
    """Labelled documents that the fit has not seen; the smallest table has too few labels to learn from."""
    sf = "/root/testdata/sf0.01"
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.judge(docs, marks.where("doc_id % 2 = 0")).join(marks.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.95 * len(got)


def test_toxicity(odd, none, labels):
    rows = toxicity.score(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in rows)
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(odd, labels.limit(0)).count() == len(TEXTS)
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_toxicity_on_held_out_documents(spark):
    """Insults among common words: passages are found, clean documents are left alone."""
    r = random.Random(6)
    rows = []
    for i in range(900):
        words = prose(r.randint(30, 150), 5000 + i).split()
        if i % 6 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs, docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r.predicted == r.toxic for r in got) and all(r.passages for r in got if r.toxic)


# ---------------------------------------------------------------- 7: near duplicates

def plain_components(texts):
    fps = [simhash.fingerprint(t) for _, t in texts]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(texts):
        least.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return Counter((i, f"{f:016x}", least[find(k)]) for k, ((i, _), f) in enumerate(zip(texts, fps, strict=True)))


def test_near_duplicates(odd, none):
    assert many(simhash.near_duplicates(odd)) == plain_components(TEXTS)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    wanted = plain_components(TEXTS)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter({i for _, _, i in wanted})


def test_near_duplicates_of_the_table(spark, sf):
    texts = documents(spark, sf)
    assert many(queries.op7_simhash(spark, sf)) == plain_components(texts)


def test_crowded_postings(spark):
    """Postings cut into blocks connect what whole postings connect."""
    r = random.Random(9)
    base = r.getrandbits(64)
    fps = list({base ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    parts = []
    for block in (20_000, 7):
        groups: dict = {}
        for row in components.components(simhash.links(df, block)).collect():
            groups.setdefault(row.root, set()).add(row.node)
        parts.append(sorted(map(sorted, groups.values())))
    assert parts[0] == parts[1] and max(map(len, parts[0])) > 200


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(50)] + [(5, 5), (None, 3)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(50)}


def test_fingerprint_hash_is_the_sql_one(spark):
    assert spark.sql("select xxhash64('a b c d') as h").first().h == simhash._signed(xxhash.xxh64_intdigest(b"a b c d", 42))


# ---------------------------------------------------------------- 8: shards

@pytest.mark.parametrize("block, fan", [(20_000, 512), (3, 2)])
def test_shards(odd, none, block, fan):
    rows = sharding.shard(odd, shards=4, block=block, fan=fan).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    assert all(len({r.shard for r in rows if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in rows})
    assert sharding.shard(none, block=block).count() == 0


def test_shards_of_the_table_are_even(spark, sf):
    loads: Counter = Counter()
    groups: Counter = Counter()
    for r in queries.op8_sharding(spark, sf).collect():
        loads[r.shard] += r["size"]
        groups[r.text_crc32] += r["size"]
    mean = sum(loads.values()) / 40
    assert max(loads.values()) <= max(1.02 * mean, max(groups.values()))


# ---------------------------------------------------------------- 10: pages

def test_page_text(spark):
    template = "<div><p>Welcome to our site</p></div>{}<p>All rights kept</p>"
    rows = [
        (1, "http://a.org/x/1", template.format("<p>One  own&nbsp;line</p>")), (2, "http://a.org/x/2", template.format("<p>Two own line</p>")), (3, "http://b.org/x/2", template.format("")),
        (4, None, None), (5, "http://[x", ""), (None, "http://c.org", "<article><p>A<p>B</article>"), (None, "http://c.org", "<article><p>A<p>B</article>"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in pagetext.main_text(pages).collect())
    alone = "Welcome to our site\nAll rights kept"
    assert got == Counter([(1, "One own line", 12), (2, "Two own line", 12), (3, alone, len(alone)), (4, "", 0), (5, "", 0), (None, "A\nB", 3), (None, "A\nB", 3)])
    assert pagetext.main_text(pages.limit(0)).count() == 0


def test_page_text_of_the_table(spark, sf):
    import html

    got = {r.page_id: (r.text, r.n_chars) for r in queries.op10_page_text(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        text = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (text, len(text))


# ---------------------------------------------------------------- the pipeline

def plain_cut(texts):
    """Texts without their 400-byte strings and their passages of 51 words that occur again; characters cut in two go whole."""
    data = [(i, t, (t or "").encode()) for i, t in texts]
    words = [[m.span() for m in re.finditer(rb"\S+", d)] for _, _, d in data]
    strings = Counter(d[k : k + 400] for _, _, d in data for k in range(len(d) - 399))
    tokens_of = [[d[a:b] for a, b in w] for (_, _, d), w in zip(data, words)]
    passages = Counter(tuple(w[k : k + 51]) for w in tokens_of for k in range(len(w) - 50))
    out = []
    for (i, t, d), spans, own in zip(data, words, tokens_of):
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if strings[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        for k in range(len(own) - 50):
            if passages[tuple(own[k : k + 51])] > 1:
                a, b = spans[k][0], spans[k + 50][1]
                gone[a:b] = b"\1" * (b - a)
        out.append((i, bytes(b for b, g in zip(d, gone) if not g).decode(errors="ignore") if any(gone) else t))
    return Counter(out)


def check_stages(spark, docs, sf):
    """Every stage on all that the one before it kept, against plain versions; returns the ids after each stage."""
    columns, ids = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, sf))
        texts = [(r.doc_id, r.text) for r in before.collect()]
        if name == "packing":
            check_packing(docs.collect(), texts, False)
            break
        assert docs.columns == columns
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        ids.append(Counter(i for i, _ in after.elements()))
        if name == "toxicity":
            clean = Counter(r.doc_id for r in toxicity.score(before, table(spark, sf, "labels")).where("predicted = 0").collect())
            assert ids[-1] == clean and sum(clean.values()) > 0.8 * len(texts)
        elif name == "simhash_near_dedup":
            assert ids[-1] == plain_kept(texts) and not after - Counter(texts)
        elif name == "suffix_dedup":
            assert after == plain_cut(texts)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            assert ids[-1] == Counter(r[0] for r in plain_hits(texts, items) if not r[-1])
    return ids


def test_pipeline(spark, sf):
    ids = check_stages(spark, table(spark, sf, "documents"), sf)
    assert all(sum(b.values()) <= sum(a.values()) for a, b in zip(ids, ids[1:])) and len(ids) == 4


def test_pipeline_on_odd_rows(spark, odd, none, sf):
    for docs in [none]:
        for _, step in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(step(spark, docs, sf))
            assert docs.count() == 0
    ids = check_stages(spark, odd, sf)
    # one of the wordless texts and of each group of copies is left
    assert ids[0][5] == 2 and ids[1][5] + ids[1][6] == 1 and ids[1][None] == 1 and sum(ids[1][i] for i in (1, 2, 3)) == 1 and ids[3][10] == 1
