"""Main text of web pages by structure and by differencing with the page of the nearest URL.

A page becomes text lines (blocks), each with its region: in the page's ``article`` or ``main``, elsewhere, or in a part that is never main text
(menus, headers, footers, sidebars, adverts, notices, forms, comments). The different pages of a host are ordered by path, copies standing
at their first path; each is paired with the neighbour whose path shares the longer beginning. The lines of both are aligned by a longest
common subsequence, and shared lines are template, for a page and all its copies. A shared line of an ``article`` or ``main`` may be a paragraph that
two pages repeat (see README), so there it is template only if half of the host's pages share it with their neighbours.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.llm.common import ARROW, from_texts
from flowgate.staging import stage

NEVER, ELSEWHERE, MAIN = 0, 1, 2
OFTEN = 16  # places of a line in a page from which they are kept as one whole number
ENOUGH = 5  # pages of a host, at least, that share a line of their marked main text before it is template there

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SILENT = frozenset("script style noscript template iframe object svg math head title select textarea button".split())
# what a head may hold; anything else ends it, as its end tag may be left out
_OF_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
_APART = frozenset("nav footer aside form dialog menu".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|comments?|replies|disqus|share|sharing|social|related|recommended|toolbar|pagination)(?:$|[\s_-])",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


class _Lines(HTMLParser):
    """Blocks of text in page order with their regions."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, region, whether text is heard
        self.lines: list[str] = []
        self.regions: list[int] = []
        self.words: list[str] = []

    def _state(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (ELSEWHERE, True)

    def _end_block(self) -> None:
        line = " ".join("".join(self.words).split())
        self.words = []
        if line:
            self.lines.append(line)
            self.regions.append(self._state()[0])

    def _end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self._end_block()
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in _OF_HEAD:
            self._end_head()
        if tag == "br":
            self.words.append(" ")
        if tag not in _INLINE:
            self._end_block()
        if tag in _VOID:
            return
        region, heard = self._state()
        if tag in ("article", "main") and region != MAIN and not self._marked():
            # the page's own text, also where a menu before it was not closed
            self.open = [o for o in self.open if o[0] in ("html", "body")]
            region, heard = MAIN, True
        elif tag in _APART or (tag == "header" and region != MAIN) or self._named(tag, attrs):
            region = NEVER
        elif tag in _SILENT:
            heard = False
        self.open.append((tag, region, heard))

    def _marked(self) -> bool:
        """Inside an element that its name or role marks as no main text, so a nested article is not either."""
        return any(tag not in _APART and tag != "header" and region == NEVER for tag, region, _ in self.open)

    @staticmethod
    def _named(tag, attrs) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        named = {k: v or "" for k, v in attrs}
        return named.get("role", "").lower() in _ROLES or "hidden" in named or any(_NAMES.search(named.get(k, "")) for k in ("class", "id"))

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.words.append(" ")
        elif tag not in _INLINE:
            self._end_block()

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self._end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        if self._state()[1]:
            self.words.append(data)

    def finish(self) -> tuple[list[str], list[int]]:
        self.close()
        self._end_block()
        return self.lines, self.regions


def lines_of(html: str | None) -> tuple[list[str], list[int]]:
    parser = _Lines()
    parser.feed(html or "")
    return parser.finish()


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def _bits(places: list[int]) -> int:
    out = bytearray(places[-1] // 8 + 1)
    for j in places:
        out[j // 8] |= 1 << j % 8
    return int.from_bytes(out, "little")


def shared_lines(a: list, b: list) -> list[bool]:
    """Which lines (or keys of lines) of ``a`` belong to a longest common subsequence with ``b``; one bit per line of ``b`` in each step.

    Lines at both ends that are equal are shared at once. Of the steps between them, every k-th one is kept, with k near the root of their number, and
    those after it are made again on the way back: memory grows with the root of one text's lines times the other one's.
    """
    n, m = len(a), len(b)
    lead = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - lead) if a[n - 1 - i] != b[m - 1 - i]), min(n, m) - lead)
    inner, other = a[lead : n - tail], b[lead : m - tail]
    where: dict[object, list[int]] = {}
    for j, line in enumerate(other):
        where.setdefault(line, []).append(j)
    # the bits of a line are made where they are needed, as most lines of a long page are met once; those of frequent lines are kept
    full = (1 << len(other)) - 1
    frequent = {line: _bits(places) for line, places in where.items() if len(places) > OFTEN}

    def bits(line) -> int:
        return frequent[line] if line in frequent else sum(1 << j for j in where.get(line, ()))

    def step(v: int, line) -> int:
        hit = v & bits(line)
        return ((v + hit) | (v - hit)) & full

    apart = max(1, int(len(inner) ** 0.5))
    kept, v = [], full
    for i, line in enumerate(inner):
        if i % apart == 0:
            kept.append(v)
        v = step(v, line)
    # a zero bit marks a step in the length of the subsequence; walk back over the rows
    shared = [False] * len(inner)
    j, after = len(other), v
    for block in range(len(kept) - 1, -1, -1):
        begin = block * apart
        lines = inner[begin : begin + apart]
        rows = [kept.pop()]
        for line in lines[:-1]:
            rows.append(step(rows[-1], line))
        for i in range(len(lines) - 1, -1, -1):
            below = (1 << j) - 1
            if (~after & below).bit_count() > (~rows[i] & below).bit_count():
                shared[begin + i] = True
                own = bits(lines[i]) & below
                j = (own & ~after or own).bit_length() - 1
            after = rows[i]
    return [True] * lead + shared + [True] * tail


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _nearer(path: str, before: tuple | None, after: tuple | None) -> tuple | None:
    """The neighbour (path, content, ...) whose path shares the longer beginning, the one before of equal ones."""
    near = [n for n in (before, after) if n is not None]
    return max(near, key=lambda n: _common(n[0], path)) if near else None


def _small(batches):
    return (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256))


def _hashed(batches):
    """Lines as 64-bit keys, and the length of each line of protected main text, 0 of others."""
    same = ("host", "path", "content", "plain")
    for batch in _small(batches):
        keys, lengths = [], []
        for lines, regions, plain in zip(*(batch.column(c).to_pylist() for c in ("lines", "regions", "plain")), strict=True):
            keys.append(b"".join(hashlib.blake2b(line.encode(), digest_size=8).digest() for line in lines))
            lengths.append(np.array([0 if plain or region != MAIN else len(line) for line, region in zip(lines, regions, strict=True)], "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([*map(batch.column, same), pa.array(keys, pa.binary()), pa.array(lengths, pa.binary())], names=[*same, "keys", "lengths"])


def _compared(plain: bool, keys: bytes, lengths: bytes, others: bytes) -> tuple[bool | None, list[int], list[int], list[int]]:
    """(telling, places, main, main_keys) of a page and the nearest one: whether less than half of the protected main text is shared, null if it has none; places of
    shared lines, if any page has them unprotected; places and keys of shared lines of that main text. Pages that share more are versions of one text and tell no template."""
    own, sizes = np.frombuffer(keys, "<i8").tolist(), np.frombuffer(lengths, "<u4").tolist()
    places = [i for i, shared in enumerate(shared_lines(own, np.frombuffer(others, "<i8").tolist())) if shared]
    main = [i for i in places if sizes[i]]
    telling = 2 * sum(sizes[i] for i in main) < sum(sizes) if any(sizes) else None
    return telling, places if plain else [], main, [own[i] for i in main]


_PAIRED = [("host", pa.string()), ("content", pa.string()), ("telling", pa.bool_()), ("places", pa.list_(pa.int32())), ("main", pa.list_(pa.int32())), ("main_keys", pa.list_(pa.int64()))]
_ORDERED = [
    ("part", pa.int32()), *_PAIRED, ("first", pa.bool_()), ("last", pa.bool_()), ("path", pa.string()), ("plain", pa.bool_()), ("keys", pa.binary()), ("lengths", pa.binary()),
    ("near_path", pa.string()), ("near", pa.string()), ("near_keys", pa.binary()),
]
_DDL = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}


def _schema(fields) -> str:
    return ", ".join(f"{name} {_DDL[kind]}" for name, kind in fields)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _neighbours(batches):
    """Pages of one range of (host, path, content) compared with their partners. Its first and last page see one side only and tell what they see."""
    part = TaskContext.get().partitionId()
    before = page = None
    out: list[tuple] = []
    nothing = (None,) * 7

    def settle(after):
        host, path, content, plain, keys, lengths = page
        left, right = (n[1:] if n is not None and n[0] == host else None for n in (before, after))
        first, last = before is None, after is None
        if first or last:
            near_path, near, _, near_keys, _ = (right if first else left) or (None,) * 5
            out.append((part, host, content, None, None, None, None, first, last, path, plain, keys, lengths, near_path, near, near_keys))
            return
        near = _nearer(path, left, right)
        if near is not None:
            out.append((part, host, content, *_compared(plain, keys, lengths, near[3]), False, False, *nothing))

    for batch in _small(batches):
        for after in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "content", "plain", "keys", "lengths")), strict=True):
            if page is not None:
                settle(after)
            before, page = page, after
        yield _batch(out, _ORDERED)
        out.clear()
    if page is not None:
        settle(None)
    yield _batch(out, _ORDERED)


def _across(ends: list) -> list[tuple[str, str, str]]:
    """(host, content, partner) of the first and last pages of all ranges, with the pages beyond; two rows per range at most."""
    ends = sorted(ends, key=lambda r: (r["part"], r["last"]))
    out = []
    for i, page in enumerate(ends):
        inside = (page["near_path"], page["near"]) if page["near"] is not None else None
        outer = [ends[k] if 0 <= k < len(ends) and ends[k]["host"] == page["host"] else None for k in (i - 1, i + 1)]
        left, right = ((n["path"], n["content"]) if n is not None else None for n in outer)
        near = _nearer(page["path"], left if page["first"] else inside, right if page["last"] else inside)
        if near is not None:
            out.append((page["host"], page["content"], near[1]))
    return out


def _at_ends(batches):
    for batch in _small(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("host", "content", "plain", "keys", "lengths", "others")), strict=True)
        yield _batch([(host, content, *_compared(*page)) for host, content, *page in rows], _PAIRED)


def compared_pages(parsed: DataFrame) -> DataFrame:
    """(host, content, telling, places, main, main_keys) of every different page of ``parsed`` whose host has another one: what it shares with the nearest."""
    spark = parsed.sparkSession
    order = ["host", "path", "content"]
    lines = parsed.select(*order, "plain", "lines", "regions").mapInArrow(_hashed, "host string, path string, content string, plain boolean, keys binary, lengths binary")
    distinct = lines.groupBy("host", "content").agg(F.min("path").alias("path"), F.max("plain").alias("plain"), F.first("keys").alias("keys"), F.max("lengths").alias("lengths"))
    ranges = distinct.select(*order, "plain", "keys", "lengths").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(ranges.mapInArrow(_neighbours, _schema(_ORDERED)))
    ends = found.where("first or last")
    across = _across(ends.select("part", *order, "first", "last", "near_path", "near").collect())
    pairs = spark.createDataFrame(across, "host string, content string, partner string")
    seen = ends.select("host", "content", "keys").union(ends.where("near is not null").select("host", "near", "near_keys")).toDF("host", "partner", "others").dropDuplicates(["host", "partner"])
    both = ends.select("host", "content", "plain", "keys", "lengths").join(pairs, ["host", "content"]).join(seen, ["host", "partner"])
    names = [n for n, _ in _PAIRED]
    return found.where("not first and not last").select(*names).union(stage(both.mapInArrow(_at_ends, _schema(_PAIRED))))


def template_lines(compared: DataFrame) -> DataFrame:
    """(host, content, plain, places): lines to delete from the pages of a content that are ``plain``, all shared ones, or protected, those that are template.

    A shared line of protected main text is template if telling pages share it, ENOUGH of them and half of all protected pages of the host. A paragraph that
    near pages repeat, or that versions of one text have, stays.
    """
    votes = compared.where("telling").select("host", F.explode(F.array_distinct("main_keys")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH)
    template = votes.join(compared.where("telling is not null").groupBy("host").agg(F.count("*").alias("pages")), "host").where("2 * n >= pages").select("host", "key")
    main = compared.select("host", "content", F.explode(F.arrays_zip(F.col("main").alias("place"), F.col("main_keys").alias("key"))).alias("line")).select("host", "content", "line.*")
    protected = main.join(template, ["host", "key"]).groupBy("host", "content").agg(F.collect_list("place").alias("places"))
    plain = compared.where("size(places) > 0").select("host", "content", F.lit(True).alias("plain"), "places")
    return stage(plain.union(protected.select("host", "content", F.lit(False).alias("plain"), "places")))


def _kept(lines: list[str], regions: list[int], places: list[int] | None) -> str:
    wanted, template = MAIN if MAIN in regions else ELSEWHERE, set(places or ())
    return "\n".join(line for i, (line, region) in enumerate(zip(lines, regions, strict=True)) if region == wanted and i not in template)


def _texts(batches):
    names = ["page_id", "url", "text", "n_chars"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [_kept(*row) for row in zip(*(part.column(c).to_pylist() for c in ("lines", "regions", "places")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, ARROW["string"]), pa.array(map(len, texts), ARROW["long"])], names=names)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", protect_main: bool = True) -> DataFrame:
    """One row per page: page_id, url, text (its blocks joined by line feeds), n_chars (code points).

    White space inside a block is one space; character references are decoded. Null and empty pages have an empty text. Null or odd
    URLs share the empty host. Pages of a host with the same lines, repeated rows among them, are copies: none is the
    other's partner. Other columns are ignored. Different pages are dealt by ranges of (host, path), so a large host is spread over
    many tasks; the ends of neighbouring ranges know each other. All different pages of a host are compared, by 64-bit keys of their lines.
    With ``protect_main=False`` every shared line goes from marked main text too.
    """

    def make(batch):
        out = {k: [] for k in ("page_id", "url", "host", "path", "content", "plain", "lines", "regions")}
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            host, path = host_and_path(url)
            lines, regions = lines_of(html)
            content = hashlib.md5("\n".join(lines).encode(errors="surrogatepass")).hexdigest()
            plain = not (protect_main and MAIN in regions)
            for k, v in zip(out, (page, url, host, path, content, plain, lines, regions), strict=True):
                out[k].append(v)
        return out

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = "page_id long, url string, host string, path string, content string, plain boolean, lines array<string>, regions array<int>"
    parsed = stage(from_texts(rows, "html", make, schema))
    told = parsed.join(template_lines(compared_pages(parsed)), ["host", "content", "plain"], "left")
    return told.select("page_id", "url", "lines", "regions", "places").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
