"""Raw files: structure, encodings, checksums, changes."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowgate.sources import csv, manifest, tables


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "Benign").mkdir()
    (tmp_path / "DDoS").mkdir()
    (tmp_path / "Benign" / "a.csv").write_text('x,y.len\n1,"a,b"\n2\n3,"say ""hi"""\n')
    (tmp_path / "DDoS" / "b.csv").write_text("y.len,z,x\nq,5,7\n")
    return tmp_path


def test_union_by_name_with_padding_and_folder_label(spark, tree):
    out = csv.read_union(spark, str(tree), types={"x": "bigint"}, label_from_folder="label")
    rows = sorted((r.x, r["y.len"], r.z, r.label) for r in out.collect())
    assert rows == [(1, "a,b", None, "Benign"), (2, None, None, "Benign"), (3, 'say "hi"', None, "Benign"), (7, "q", "5", "DDoS")]
    assert out.columns == ["x", "y.len", "z", "source_file", "label"]
    assert out.count() == 4


@pytest.mark.parametrize("line", ["1,2,3\n", "word,b\n", "word\n", '1,"a\nb",3\n'])
def test_union_is_strict(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text("x,y\n" + line)
    with pytest.raises(Exception, match="malformed record"):
        csv.read_union(spark, str(tmp_path), types={"x": "bigint"}).collect()


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.read_union(spark, str(tmp_path))


def test_every_line_is_good_or_rejected(spark, tree):
    (tree / "DDoS" / "c.csv").write_text("x,y.len\n1,2\n1,2,3\n4\n")
    good, bad = csv.validate(spark, str(tree))
    assert good.count() == 4 and bad.count() == 3
    assert sorted((r.record, r.expected_fields, r.parsed_fields) for r in bad.collect()) == [("1,2,3", 2, 3), ("2", 2, 1), ("4", 2, 1)]
    report = {r.source_file.rsplit("/", 1)[1]: r for r in csv.parser_report(spark, str(tree)).collect()}
    assert (report["c.csv"].rows_total, report["c.csv"].rows_valid, report["c.csv"].observed_column_counts) == (3, 1, {1: 1, 2: 1, 3: 1})
    assert report["a.csv"].header_matches_canonical and not report["b.csv"].header_matches_canonical
    assert report["a.csv"].header_hash == hashlib.sha256(b"x,y.len").hexdigest()
    total = csv.parser_summary(csv.parser_report(spark, str(tree))).first()
    assert (total.files, total.rows_total, total.rows_invalid, total.header_schema_groups) == (3, 7, 3, 2)


def test_token_probe_matches_whole_fields(spark, tree):
    (tree / "DDoS" / "c.csv").write_text("x,y\n1.2.3.4,b\n11.2.3.45,b\n")
    hits = csv.find_token(spark, str(tree), "1.2.3.4").collect()
    assert [(h.expected_fields, h.parsed_fields, h.row_prefix) for h in hits] == [(2, 2, ["1.2.3.4", "b"])]


def test_quoted_line_breaks_are_part_of_the_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n1,"p\nq, ""r""\n",3\n4,5,6\n7,"8\n9"\n')
    rows = sorted(tuple(r)[:3] for r in csv.read_union(spark, str(tmp_path), types={"x": "int"}).collect())
    assert rows == [(1, 'p\nq, "r"\n', "3"), (4, "5", "6"), (7, "8\n9", None)]
    good, bad = csv.validate(spark, str(tmp_path))
    assert good.count() == 2 and [(r.record, r.parsed_fields) for r in bad.collect()] == [('7,"8\n9"', 2)]
    assert {(r.fields, r.rows) for r in csv.field_counts(spark, str(tmp_path)).collect()} == {(3, 2), (2, 1)}
    assert [r.parsed_fields for r in csv.find_token(spark, str(tmp_path), "8\n9").collect()] == [2]


def test_headers_in_their_own_encoding(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("größe,\"a\nb\"\nné,2\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("\ufeffgröße,c\né,3\n".encode())
    out = csv.read_union(spark, str(tmp_path))
    assert out.columns == ["größe", "a\nb", "c", "source_file"]
    assert sorted(r[0] for r in out.collect()) == ["né", "é"]
    listed = {r.file_name: r for r in manifest.file_manifest(spark, str(tmp_path)).collect()}
    assert (listed["l.csv"].columns, listed["l.csv"].encoding, listed["u.csv"].encoding) == ('["größe","a\\nb"]', "latin-1", "utf-8-sig")


def test_long_headers_are_whole(spark, tmp_path):
    names = [f"a_rather_long_column_name_{i}" for i in range(8000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    row = manifest.file_manifest(spark, str(tmp_path)).first()
    assert row.columns_count == 8000 and json.loads(row.columns) == names and row.rows == 1


def test_a_data_line_like_the_header_is_data(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\nx,y\n1,2\nx,y\n")
    assert csv.find_token(spark, str(tmp_path), "x").count() == 2
    assert [(r.fields, r.rows) for r in csv.field_counts(spark, str(tmp_path)).collect()] == [(2, 3)]


def test_fields_are_split_in_linear_time(spark):
    line = ",".join(['"a,b"', "", "c", '"d ""e"""'] * 20_000)
    out = spark.createDataFrame([(line,), ("",), (",a",), ("a,",)], "v string").select(csv.split_fields(F.col("v")).alias("f"), csv._field_count(F.col("v")).alias("n")).collect()
    assert out[0].f[:4] == ["a,b", "", "c", 'd "e"'] and len(out[0].f) == 80_000 == out[0].n
    assert [(r.f, r.n) for r in out[1:]] == [([""], 1), (["", "a"], 2), (["a", ""], 2)]


def test_manifest_facts(spark, tree):
    (tree / "bom.txt").write_bytes(b"\xef\xbb\xbfhello\n")
    (tree / "latin.txt").write_bytes("café".encode("latin-1"))
    (tree / "wide.txt").write_bytes(("x" * 65_535 + "é" * 10).encode())
    (tree / "raw.bin").write_bytes(b"\x00\x01")
    keys = ["relative_path", "size_bytes", "sha256", "rows", "columns", "columns_count", "encoding", "file_type"]
    found = {r[0]: tuple(r) for r in manifest.file_manifest(spark, str(tree)).select(*keys).collect()}
    assert {n: found[n][6] for n in ("bom.txt", "latin.txt", "wide.txt", "raw.bin")} == {
        "bom.txt": "utf-8-sig", "latin.txt": "latin-1", "wide.txt": "utf-8", "raw.bin": ""
    }
    data = (tree / "Benign" / "a.csv").read_bytes()
    assert found["Benign/a.csv"][1:6] == (len(data), hashlib.sha256(data).hexdigest(), 3, '["x","y.len"]', 2)
    assert found["raw.bin"][3] is None


def test_refreshed_manifest_reads_changed_files_only(spark, tree):
    first = manifest.file_manifest(spark, str(tree))
    stored = first.withColumn("sha256", F.when(F.col("file_name") == "a.csv", "kept").otherwise(F.col("sha256")))
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    (tree / "DDoS" / "b.csv").write_text("y.len,z,x\nq,5,7\nr,6,8\n")
    (tree / "new.csv").write_text("x\n1\n")
    out = {r.relative_path: r for r in manifest.refresh_manifest(spark, str(tree), stored).collect()}
    assert set(out) == {"Benign/a.csv", "DDoS/b.csv", "new.csv"}
    assert out["Benign/a.csv"].sha256 == "kept" and out["DDoS/b.csv"].rows == 2
    status = {r.path.rsplit("/", 1)[1]: r.status for r in manifest.manifest_diff(csv.discover(spark, str(tree)), stored).collect()}
    assert status == {"a.csv": "unchanged", "b.csv": "changed", "new.csv": "added"}


def test_run_records_one_per_file(spark, tmp_path):
    for seed in (1, 2):
        (tmp_path / f"d{seed}").mkdir()
        (tmp_path / f"d{seed}" / "run.json").write_text(json.dumps({"dataset": "d", "seed": seed, "f1": 0.5}, indent=2))
    out = tables.read_runs(spark, str(tmp_path), "dataset string, seed int, f1 double")
    assert sorted(r.seed for r in out.collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        tables.read_runs(spark, str(tmp_path), "dataset string", pattern="*.none")
