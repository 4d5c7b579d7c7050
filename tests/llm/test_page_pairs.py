"""Pages without marked main text: copies, recaptures and ranges."""

from __future__ import annotations

from collections import Counter

import pytest

from flowgate.llm import pagetext

TEMPLATE = "<div><p>Welcome to our site</p></div>{}<p>All rights kept</p>"


def texts(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return Counter((r.page_id, r.text) for r in pagetext.main_text(pages, **options).collect())


def test_copies_are_not_partners(spark):
    own = [TEMPLATE.format(f"<p>Line {i}</p>") for i in range(3)]
    rows = [(1, "http://a.org/x/1", own[0]), (1, "http://a.org/x/1", own[0]), (2, "http://a.org/x/1?s=2", own[0]), (3, "http://a.org/z/9", own[0]), (4, "http://a.org/y", own[1]), (5, "http://b.org/x", own[2]), (6, "http://b.org/x?p", own[2])]
    alone = "Welcome to our site\nLine 2\nAll rights kept"
    assert texts(spark, rows) == Counter([(1, "Line 0"), (1, "Line 0"), (2, "Line 0"), (3, "Line 0"), (4, "Line 1"), (5, alone), (6, alone)])
    marked = [(i, u, f"<main>{h}</main>") for i, u, h in rows]
    assert texts(spark, marked)[4, "Welcome to our site\nLine 1\nAll rights kept"] == 1
    assert texts(spark, marked, protect_main=False) == texts(spark, rows)


def plain(rows):
    parsed = [(i, *pagetext.host_and_path(u), tuple(pagetext.lines_of(h)[0])) for i, u, h in rows]
    out = Counter()
    for i, host, _, lines in parsed:
        first = {}
        for _, h, p, x in parsed:
            if h == host:
                first[x] = min(p, first.get(x, p))
        order = sorted((p, pagetext.hashlib.md5("\n".join(x).encode()).hexdigest(), x) for x, p in first.items())
        at = [x for _, _, x in order].index(lines)
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        partner = max(near, key=lambda n: pagetext._common(n[0], first[lines]))[2] if near else ()
        shared = pagetext.shared_lines(list(lines), list(partner))
        out[i, "\n".join(x for x, s in zip(lines, shared, strict=True) if not s)] += 1
    return out


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_partners_do_not_depend_on_ranges(spark, parts):
    rows = [(i, f"http://{'abc'[i % 3]}.org/{i % 4}/{'x' * (i % 5)}{i}?q={i}", f"<p>Site {i % 3}</p><p>Part {i % 4}</p><p>Line {i // 2}</p><p>End</p>") for i in range(40)] + [(90, "http://d.org/", "<p>Alone</p>"), (91, "http://a.org/0", "")]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert texts(spark, rows) == plain(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_alignment_is_a_longest_common_subsequence():
    import random

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 14))] for _ in range(2))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        shared = pagetext.shared_lines(a, b)
        kept, at = [x for x, s in zip(a, shared) if s], 0
        for y in b:
            at += at < len(kept) and kept[at] == y
        assert len(shared) == len(a) and len(kept) == longest[-1][-1] == at


def test_very_many_lines_need_little_memory():
    import tracemalloc

    a = [f"line {i}" for i in range(20_000)]
    b = [x for i, x in enumerate(a) if i % 3] + ["end"]
    tracemalloc.start()
    shared = pagetext.shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shared == [bool(i % 3) for i in range(20_000)] and peak < 12 << 20


def test_a_head_may_end_without_its_tag():
    for page, wanted in (
        ("<html><head><title>t</title><body><p>Hello</p></body></html>", ["Hello"]), ("<head><meta name=a><title>t</title><p>One<p>Two", ["One", "Two"]),
        ("<head><style>x {}</style>Text<div>More</div>", ["Text", "More"]), ("<html><head><title>t</title></head><body>In</body>", ["In"]), ("<head><script>var a = 1</script>\n<link href=x>\n<main>M</main>", ["M"]),
    ):
        assert pagetext.lines_of(page)[0] == wanted


STORY = "<header><p>Site</p></header><article><h1>Story {0}</h1><p>Share this story</p><p>{1}</p>{2}<p>Filed under: news</p></article>"


def stories(host, n, extra=None):
    """Articles whose template lines have no telling class; every third has a paragraph that its neighbour repeats."""
    return [(i, f"http://{host}/{i:03}", STORY.format(i, f"What happened on day {i}, at length and in many words", (extra or {}).get(i, ""))) for i in range(n)]


def told(i, *more, template=()):
    return "\n".join([f"Story {i}", *template[:1], f"What happened on day {i}, at length and in many words", *more, *template[1:]])


TOLD = ("Share this story", "Filed under: news")


def test_template_lines_of_marked_text_go_and_shared_paragraphs_stay(spark):
    said = "<p>The mayor said so.</p>"
    rows = stories("a.org", 12, {2: said, 3: said, 7: said}) + [(i + 20, u, h) for i, u, h in stories("b.org", 4)]
    wanted = Counter((i, told(i, *["The mayor said so."] * (i in (2, 3, 7)))) for i in range(12))
    # four pages do not tell what is template
    wanted += Counter((i + 20, told(i, template=TOLD)) for i in range(4))
    assert texts(spark, rows) == wanted
    copies = rows + [(50 + i, u + "/copy", h) for i, u, h in rows[:3]] + rows[:1]
    assert texts(spark, copies) == wanted + Counter((50 + i, told(i, *["The mayor said so."] * (i == 2))) for i in range(3)) + Counter([(0, told(0))])


def test_versions_of_one_text_tell_no_template(spark):
    body = "".join(f"<p>Paragraph {k} of a long report that was changed again and again</p>" for k in range(8))
    rows = [(i, f"http://a.org/report/{i:02}", f"<main>{body}<p>Version {i}</p></main>") for i in range(9)] + [(20 + i, f"http://a.org/{u[-3:]}", h) for i, u, h in stories("a.org", 12)]
    got = dict(texts(spark, rows).keys())
    assert all(got[i] == "\n".join(pagetext.lines_of(rows[i][2])[0]) for i in range(9))
    assert all(got[20 + i] == told(i) for i in range(12))


def test_versions_of_a_short_text_keep_it(spark):
    long = [(i, f"http://a.org/long/{i:02}", f"<main><p>A report that is much longer than its number</p><p>{i}</p></main>") for i in range(9)]
    short = [(20 + i, f"http://a.org/short/{i:02}", f"<main><p>Version {i} of this page</p><p>Short.</p></main>") for i in range(8)]
    assert texts(spark, long + short) == Counter((i, "\n".join(pagetext.lines_of(h)[0])) for i, _, h in long + short)


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_marked_text_does_not_depend_on_ranges(spark, parts):
    rows = [(i, f"http://{'abc'[i % 3]}.org/{i % 4}/{'x' * (i % 5)}{i}", STORY.format(i, f"What happened on day {i}, at length", f"<p>Quote {i // 6}</p>" * (i % 2))) for i in range(48)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert texts(spark, rows) == Counter((i, "\n".join([f"Story {i}", f"What happened on day {i}, at length", *[f"Quote {i // 6}"] * (i % 2)])) for i in range(48))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_every_given_page_with_a_neighbour_is_compared(spark, sf, monkeypatch):
    from flowgate.llm import queries

    seen = []
    monkeypatch.setattr(pagetext, "compared_pages", lambda parsed, compare=pagetext.compared_pages: seen.append(compare(parsed)) or seen[-1])
    pages = [(pagetext.host_and_path(r.url)[0], tuple(pagetext.lines_of(r.html)[0])) for r in queries.table(spark, sf, "pages").collect()]
    queries.op10_page_text(spark, sf).count()
    different = Counter(host for host, _ in set(pages))
    assert Counter(r.host for r in seen[0].select("host").collect()) == Counter({host: n for host, n in different.items() if n > 1})
