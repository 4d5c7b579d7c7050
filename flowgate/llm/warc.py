"""Web archives: records written and read back, and a capture index by external merge.

Archives are plain or gzip files of WARC 1.1 records. A payload that occurs more than once is stored with the smallest page id; the other records
revisit it. Each archive that is read back gives one run of captures, sorted by URL key and time in the task that
read it. Runs are cut by common ranges of the key, and in each range a loser tree merges the k run segments, so that the
ranges together are one globally ordered index of capture histories.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.staging import stage_path

FILE_RECORDS = 20_000  # records in one archive file
FIRST_CAPTURE = 1_704_067_200  # seconds; pages carry no time, so captures are that many seconds after it as their id says
YEAR = 31_536_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal column: five digits are four characters."""
    characters = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            characters.append(F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*characters)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """One record per row. Equal payloads of at least ``min_bytes`` bytes are stored once; null payloads are empty ones."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("sha1"),
    )
    # rows are counted per digest before the shuffle, so a payload with very many copies is one row per task
    first = rows.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"))
    kinds = rows.join(first, ["sha1", "bytes"]).withColumn("again", (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit("\r\n\r\n"))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    seconds = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(YEAR))
    time = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit("\r\nWARC-Target-URI: "), "url", F.lit("\r\nWARC-Date: "), time, F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.when(F.col("again"), F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), "block",
    )
    # the end of a record is the end of a line of the text writer
    kinds.withColumn("block", block).select(record.alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).text(path, compression="gzip", lineSep="\r\n\r\n")


def records(data: bytes):
    """(offset, length, headers, block) of each record of an archive; offsets are in the unpacked archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    at = 0
    while line := stream.readline():
        size = len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            key, _, value = line.decode().partition(":")
            headers[key.lower()] = value.strip()
        size += len(line)
        length = int(headers["content-length"])
        block = stream.read(length)
        end = stream.read(4)
        if len(block) < length or end != b"\r\n\r\n":
            raise ValueError(f"cut record at byte {at}")
        size += length + 4
        yield at, size, headers, block
        at += size


def url_key(url: str) -> str:
    """Host names from the top, then path and query in lower case; no scheme, no port 80 or 443, no fragment."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = "" if parts.port in (None, 80, 443) else f":{parts.port}"
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


_CAPTURES = "url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, length long"
_NAMES = [f.split()[0] for f in _CAPTURES.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64()}[f.split()[1]] for f in _CAPTURES.split(", ")]


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").rstrip(">")
    return None if digits in ("null", "") else int(digits)


def _captures(data: bytes, run: str) -> list[tuple]:
    out = []
    for offset, length, headers, block in records(data):
        head, _, payload = block.partition(b"\r\n\r\n")
        declared = int(head.rpartition(b"Content-Length: ")[2])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        kind = headers["warc-type"]
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if (own, len(payload)) != (digest, declared):
                raise ValueError(f"{run}: payload at {offset} does not match its digest")
        out.append((url_key(headers["warc-target-uri"]), headers["warc-date"], _number(headers["warc-record-id"]), declared, digest, kind, _number(headers.get("warc-refers-to")), run, offset, length))
    return out


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _runs(batches):
    """The captures of each archive file as one sorted run."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield _batch(sorted(_captures(content.as_py(), path.as_py()), key=_order))


def merged(runs: list[list[tuple]]):
    """K-way merge of sorted runs by a loser tree: inner nodes hold the runs that lost there, the winner plays its path again."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    last = (1,)
    keys = [(0, _order(run[0])) if run else last for run in runs]

    def beats(a: int, b: int) -> bool:
        return (keys[a], a) < (keys[b], b)

    tree = [0] * k  # tree[0] is the winner
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    winner = winners[1] if k > 1 else 0
    while keys[winner] is not last:
        yield runs[winner][at[winner]]
        at[winner] += 1
        keys[winner] = (0, _order(runs[winner][at[winner]])) if at[winner] < len(runs[winner]) else last
        node = (winner + k) // 2
        while node:
            if beats(tree[node], winner):
                winner, tree[node] = tree[node], winner
            node //= 2


def _merge_range(batches):
    """One range of the key: the segments of all runs, in whatever order their rows came."""
    segments: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            segments.setdefault(row[7], []).append(row)
    runs = []
    for run in sorted(segments):
        rows = segments.pop(run)
        keys = list(map(_order, rows))
        runs.append(rows if all(a <= b for a, b in zip(keys, keys[1:], strict=False)) else sorted(rows, key=_order))
    out = []
    for row in merged(runs):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives below ``path``, ordered by (url_key, time, page_id) inside and across partitions.

    A hot URL is no obstacle: ranges are cut by time and page as well. Damaged records raise.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = files.mapInArrow(_runs, _CAPTURES)
    return runs.repartitionByRange("url_key", "time", "page_id").mapInArrow(_merge_range, _CAPTURES)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives below ``path`` (a folder of its own in the checkpoint folder by default) and returns their capture index.

    One row per row of ``pages``. Empty and null payloads are equal payloads of 0 bytes. Rows that repeat a page id with its payload
    are both responses if the id is the smallest. A null id is a response only where all ids of its payload are null. A null
    URL has the key of an empty one; other columns are ignored.
    """
    path = path or stage_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    return capture_index(pages.sparkSession, path)
