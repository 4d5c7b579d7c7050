"""Large CSV files: records found by byte blocks against the records found front to back."""

from __future__ import annotations

import csv as plain_csv
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowgate.sources import blocks, csv


def cut(data: str) -> list[str]:
    """Raw records, front to back: a line feed ends one unless a quote is open."""
    out, quotes, last = [], 0, ""
    for c in data:
        quotes += c == '"'
        if c == "\n" and quotes % 2 == 0:
            out.append(last)
            last = ""
        else:
            last += c
    return out + ([last] if last else [])


def by_blocks(path, size, encoding="utf-8", returns=False):
    """The two passes without Spark."""
    length = path.stat().st_size
    start = 3 if encoding == "utf-8-sig" else 0
    inside = number = 0
    out, wrong = [], False
    for begin in range(start, length, size):
        end = min(begin + size, length)
        parity, *ends, w0, w1 = blocks.block_facts(str(path.as_uri()), begin, end, start)
        for numbers, texts in blocks.block_records(str(path.as_uri()), begin, end, inside, number, encoding, returns):
            out += zip(numbers.tolist(), texts.to_pylist())
        wrong |= w1 if inside else w0
        number += ends[inside]
        inside ^= parity
    return out, wrong or inside == 1


FIELDS = ["", "a", "12", '""', '"x,y"', '"a\nb"', '"say ""hi"""', '"\n"', "é", '"é\r\n,ü"', '""""']


@pytest.mark.parametrize("seed", range(5))
def test_random_files(tmp_path, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(blocks, "CHUNK", r.choice([3, 10, 1 << 20]))
    for k in range(30):
        data = "".join(",".join(r.choice(FIELDS) for _ in range(r.randint(1, 4))) + "\n" for _ in range(r.randint(1, 12)))
        data = data if r.random() < 0.7 else data + "x"
        path = tmp_path / f"f{seed}_{k}.csv"
        path.write_bytes(data.encode())
        for size in (1, 2, 5, 17, 10_000):
            found, irregular = by_blocks(path, size)
            assert found == list(enumerate(cut(data), 1))
            assert not irregular


@pytest.mark.parametrize("data", ['a"b,c\n1,2\n', 'a,"b"c\n', 'x,y\n"open,1\n2,3\n', 'x\n"a""\n', 'x,y\n1, "a"\n'])
def test_quotes_in_odd_places_are_noticed(tmp_path, data):
    path = tmp_path / "odd.csv"
    path.write_text(data)
    assert all(by_blocks(path, size)[1] for size in (1, 3, 100))


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*sorted(f"`{c}`" for c in df.columns)).collect())


@pytest.fixture
def tree(tmp_path):
    r = random.Random(9)
    fields = [f for f in FIELDS if f not in ("", '""')]
    for name, encoding, end in (("plain", "utf-8", "\n"), ("marked", "utf-8-sig", "\n"), ("latin", "latin-1", "\n"), ("returns", "utf-8", "\r\n")):
        lines = ['größe,"b\nc",d' if name != "returns" else "e,f,d"] + [",".join(r.choice(fields) for _ in range(r.choice([3, 3, 3, 2, 4]))) for _ in range(120)] + [""] + ["1,2,3"]
        (tmp_path / f"{name}.csv").write_bytes((end.join(lines) + end).encode(encoding))
    (tmp_path / "odd.csv").write_text("x,y\n" + 'a"b,c\n' * 60)
    return tmp_path


def test_blocks_give_the_rows_of_whole_files(spark, tree):
    for block_bytes in (40, 700):
        for a, b in zip(csv.validate(spark, str(tree)), csv.validate(spark, str(tree), block_bytes=block_bytes)):
            assert rows_of(a) == rows_of(b) and a.columns == b.columns
    assert rows_of(csv.field_counts(spark, str(tree))) == rows_of(csv.field_counts(spark, str(tree), block_bytes=50))


def test_union_by_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f'{i},"line {i}\nof ""two"""\n' for i in range(300)))
    (tmp_path / "b.csv").write_text("y,z\n" + "".join(f"{i},\n" for i in range(300)))
    big = csv.read_union(spark, str(tmp_path), types={"x": "int"}, block_bytes=500)
    assert rows_of(big) == rows_of(csv.read_union(spark, str(tmp_path), types={"x": "int"}))
    (tmp_path / "c.csv").write_text("x,y\n" + "1,2,3\n" * 100)
    with pytest.raises(Exception, match="malformed record"):
        csv.read_union(spark, str(tmp_path), types={"x": "int"}, block_bytes=500).collect()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("x,y\n" + "".join(f'{i},"a\n{i}"\n' for i in range(4000)))
    rows = csv.records(spark, str(tmp_path), block_bytes=path.stat().st_size // 12)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 8 and sum(t["count"] for t in tasks) == 4001 and max(t["count"] for t in tasks) < 1200
    assert [r.line for r in rows.orderBy("line").collect()] == list(range(1, 4002))


def test_single_field_records_keep_their_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n"x,y"\n3,4\n"q"\n')
    report = csv.parser_report(spark, str(tmp_path)).first()
    assert (report.rows_total, report.rows_valid, report.rows_invalid, report.observed_column_counts) == (4, 2, 2, {1: 2, 2: 2})
    assert sorted((r.record, r.parsed_fields) for r in csv.validate(spark, str(tmp_path))[1].collect()) == [('"q"', 1), ('"x,y"', 1)]
    (tmp_path / "a.csv").write_text('a\n"x,y"\n\n"z"\n')
    assert [(r.line, r.value) for r in csv.records(spark, str(tmp_path)).orderBy("line").collect()] == [(1, "a"), (2, '"x,y"'), (4, '"z"')]
    assert [r.observed_column_counts for r in csv.parser_report(spark, str(tmp_path)).collect()] == [{1: 2}]
    assert csv.validate(spark, str(tmp_path))[0].count() == 2


def test_probe_numbers_records_as_a_reader_does(spark, tmp_path):
    text = "x,y\n" + "".join(f'{i},"a\nb"\n' if i % 3 else f"{i},hit\n" for i in range(50)) + "\nlast,hit\n"
    (tmp_path / "a.csv").write_text(text)
    wanted = [n for n, row in enumerate(plain_csv.reader(io.StringIO(text)), 1) if "hit" in row]
    for block_bytes in (csv.BLOCK_BYTES, 64):
        assert [r.line for r in csv.find_token(spark, str(tmp_path), "hit", block_bytes=block_bytes).collect()] == wanted


def test_small_blocks_are_read_as_such_and_share_tasks(spark, tmp_path, monkeypatch):
    """What a task reads and holds depends on the block, not on the file; small blocks make no more tasks than there is work."""
    from flowgate.sources import blocks

    path = tmp_path / "many.csv"
    path.write_bytes(b"a,b\n" + b"".join(b'%d,"x\n%d"\n' % (i, i) for i in range(200_000)))
    size, read = path.stat().st_size, []
    chunks = blocks._chunks

    def counted(*args, **more):
        for at, chunk in chunks(*args, **more):
            read.append(len(chunk))
            yield at, chunk

    monkeypatch.setattr(blocks, "_chunks", counted)
    found = list(blocks.block_records(str(path), 1 << 20, (1 << 20) + 4096, 0, 0, "utf-8", False))
    assert sum(read) <= 3 * 4096 and sum(len(t) for _, t in found) > 100
    largest = max(len(t) for _, t in blocks.block_records(str(path), 0, size, 0, 0, "utf-8", False))
    assert largest <= 10_000
    listed = spark.range(0, size, 512).selectExpr("id AS begin", "id + 512 AS end")
    assert blocks._dealt(listed).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
