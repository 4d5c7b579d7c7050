"""Raw files: the given tables written as CSV trees and run records, then read, validated and listed."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Query, flows, rounded, table
from catalog.models import CLEAN_RUNS, clean_runs
from flowgate.sources import csv as C
from flowgate.sources import manifest as MF
from flowgate.sources import tables as TB
from flowgate.staging import stage, stage_path

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TYPES = {"l_orderkey": "bigint", "l_quantity": "double", "l_linenumber": "int", "l_tax": "double"}


def line_files(spark, sf) -> str:
    """Lines as CSV in one folder per return flag; flag N is written with other columns, in another order."""
    root = stage_path(spark, "lines")
    rows = table(spark, sf, "lineitem")
    for flag, columns in (("A", ["l_orderkey", "l_linenumber", "l_quantity"]), ("R", ["l_orderkey", "l_linenumber", "l_quantity"]),
                          ("N", ["l_quantity", "l_tax", "l_orderkey", "l_linenumber"])):
        TB.write_csv(rows.where(F.col("l_returnflag") == flag).select(*columns), f"{root}/{flag}")
    return root


QUERIES["csv_union"] = lambda spark, sf: C.read_union(spark, line_files(spark, sf), types=TYPES, label_from_folder="original_label").drop("source_file")
ORACLE["csv_union"] = """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'N' THEN l_tax END AS l_tax, l_returnflag AS original_label FROM lineitem"""



def _line_breaks(spark, sf):
    """Quoted fields with line breaks, commas and quotes, in a Latin-1 file with a header that is not ASCII."""
    root = stage_path(spark, "breaks")
    text = F.concat(F.col("o_orderpriority"), F.lit("\n\"é\", "), F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("größe"), "o_totalprice")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "ISO-8859-1").csv(root)
    return C.read_union(spark, root, types={"o_orderkey": "bigint", "o_totalprice": "double"}).drop("source_file").withColumnRenamed("größe", "note")


QUERIES["csv_line_breaks"] = _line_breaks
ORACLE["csv_line_breaks"] = """SELECT o_orderkey, o_orderpriority || chr(10) || '"é", ' || o_orderstatus AS note, o_totalprice FROM orders"""

HEADER = "event_id,kind,note,value"
SHARDS = 8


def packet_files(spark, sf) -> str:
    """Events as raw CSV lines in folders by event type: some with a field too many, some with one missing,
    and notes that hold commas and quotes."""
    root = stage_path(spark, "packets")
    e = F.col("event_id")
    note = F.when(e % 11 == 0, '"a, ""quoted"" note"').when(e % 7 == 0, "192.168.0.128").otherwise("plain")
    line = F.concat_ws(",", e.cast("string"), "event_type", note, F.col("value").cast("string"))
    line = F.when(e % 97 == 0, F.concat(line, F.lit(",extra"))).when(e % 89 == 0, F.concat_ws(",", e.cast("string"), F.col("event_type"))).otherwise(line)
    # A header has to open each file: eight files per type, each written front to back by one task.
    events = table(spark, sf, "events").select(F.col("event_type").alias("kind_folder"), (e % SHARDS).alias("shard"), F.lit(1).alias("place"), line.alias("value"))
    shards = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARDS - 1).cast("bigint"))).alias("shard")
    heads = events.select("kind_folder").distinct().select("kind_folder", shards, F.lit(0).alias("place"), F.lit(HEADER).alias("value"))
    lines = heads.unionByName(events).repartition("kind_folder", "shard").sortWithinPartitions("kind_folder", "shard", "place", "value")
    lines.drop("place").write.partitionBy("kind_folder", "shard").text(root)
    return root


_PACKET_KINDS = """lines AS (SELECT event_id, event_type, CAST(event_id % 8 AS VARCHAR) AS shard, CASE WHEN event_id % 97 = 0 THEN 5 WHEN event_id % 89 = 0 THEN 2 ELSE 4 END AS fields, value,
  CASE WHEN event_id % 11 = 0 THEN 'a, "quoted" note' WHEN event_id % 7 = 0 THEN '192.168.0.128' ELSE 'plain' END AS note FROM events)"""

_TXT = "*.txt"

QUERIES["csv_valid_rows"] = lambda spark, sf: C.validate(spark, packet_files(spark, sf), _TXT)[0].drop("source_file")
ORACLE["csv_valid_rows"] = f"""WITH {_PACKET_KINDS} SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind, note, CAST(value AS VARCHAR) AS value FROM lines WHERE fields = 4"""

QUERIES["csv_rejects"] = lambda spark, sf: C.validate(spark, packet_files(spark, sf), _TXT)[1].groupBy("expected_fields", "parsed_fields").agg(F.count(F.lit(1)).alias("rows"))
ORACLE["csv_rejects"] = f"WITH {_PACKET_KINDS} SELECT 4::INTEGER AS expected_fields, fields::INTEGER AS parsed_fields, count(*) AS rows FROM lines WHERE fields <> 4 GROUP BY fields"


def _kind(df):
    return df.select(
        F.regexp_extract("source_file", r"kind_folder=([^/]+)/", 1).alias("kind"), F.regexp_extract("source_file", r"shard=(\d+)/", 1).alias("shard"),
        *[c for c in df.columns if c != "source_file"],
    )


QUERIES["csv_field_counts"] = lambda spark, sf: _kind(C.field_counts(spark, packet_files(spark, sf), _TXT))
ORACLE["csv_field_counts"] = f"WITH {_PACKET_KINDS} SELECT event_type AS kind, shard, fields::INTEGER AS fields, count(*) AS rows FROM lines GROUP BY ALL"

QUERIES["csv_parser_report"] = lambda spark, sf: _kind(C.parser_report(spark, packet_files(spark, sf), _TXT)).withColumn(
    "observed_column_counts", F.to_json("observed_column_counts")
)
ORACLE["csv_parser_report"] = f"""WITH {_PACKET_KINDS}, c AS (SELECT event_type AS kind, shard, fields, count(*) AS n FROM lines GROUP BY ALL)
SELECT kind, shard, 4::INTEGER AS expected_columns, sha256('{HEADER}') AS header_hash, true AS header_matches_canonical, CAST(sum(n) AS BIGINT) AS rows_total,
 CAST(coalesce(sum(n) FILTER (WHERE fields = 4), 0) AS BIGINT) AS rows_valid, CAST(coalesce(sum(n) FILTER (WHERE fields <> 4), 0) AS BIGINT) AS rows_invalid,
 '{{' || string_agg('"' || fields || '":' || n, ',' ORDER BY fields) || '}}' AS observed_column_counts FROM c GROUP BY kind, shard"""

QUERIES["csv_parser_summary"] = lambda spark, sf: rounded(C.parser_summary(C.parser_report(spark, packet_files(spark, sf), _TXT)))
ORACLE["csv_parser_summary"] = f"""WITH {_PACKET_KINDS} SELECT count(DISTINCT (event_type, shard)) AS files, count(*) AS rows_total, count(*) FILTER (WHERE fields = 4) AS rows_valid,
 count(*) FILTER (WHERE fields <> 4) AS rows_invalid, 1::BIGINT AS header_schema_groups, round((100.0 * count(*) FILTER (WHERE fields <> 4) / count(*))::DOUBLE, 6) AS malformed_pct FROM lines"""

QUERIES["csv_token_probe"] = lambda spark, sf: C.find_token(spark, packet_files(spark, sf), "192.168.0.128", _TXT).select(
    "line", "expected_fields", "parsed_fields", F.array_join("row_prefix", "|").alias("row_prefix")
)
# The files hold the header and the lines in byte order.
_CONTENTS = f"""raw AS (SELECT event_type, event_id % 8 AS shard, CAST(event_id AS VARCHAR) || ',' || event_type AS front,
  CASE WHEN event_id % 11 = 0 THEN '"a, ""quoted"" note"' WHEN event_id % 7 = 0 THEN '192.168.0.128' ELSE 'plain' END || ',' || CAST(value AS VARCHAR) AS back, event_id FROM events),
 packed AS (SELECT event_type, shard, CASE WHEN event_id % 97 = 0 THEN front || ',' || back || ',extra' WHEN event_id % 89 = 0 THEN front ELSE front || ',' || back END AS line FROM raw),
 contents AS (SELECT event_type AS kind, CAST(shard AS VARCHAR) AS shard, '{HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) AS body FROM packed GROUP BY ALL)"""
ORACLE["csv_token_probe"] = f"""WITH {_CONTENTS}, numbered AS (SELECT *, 1 + row_number() OVER (PARTITION BY event_type, shard ORDER BY line) AS number, string_split(line, ',') AS fields FROM packed)
SELECT number AS line, 4::INTEGER AS expected_fields, len(fields)::INTEGER AS parsed_fields, replace(line, ',', '|') AS row_prefix FROM numbered
WHERE list_contains(fields, '192.168.0.128') ORDER BY event_type, shard, number LIMIT 20"""

BLOCK = 1 << 14


FILE_ROWS = 500_000


def _large_file(spark, sf):
    """Orders in files of at most half a million rows or so, each of many blocks, with quoted line breaks, commas and quotes; many tasks share a file block by block."""
    root = stage_path(spark, "large")
    note = F.concat(F.col("o_orderpriority"), F.lit("\n\"é\", "), F.repeat(F.lit("line\n"), (F.col("o_orderkey") % 5).cast("int")))
    orders = table(spark, sf, "orders")
    files = orders.count() // FILE_ROWS + 1
    rows = orders.select("o_orderkey", note.alias("note"), "o_totalprice")
    # one file is written by one task, so more rows make more files
    (rows.repartition(files, "o_orderkey") if files > 1 else rows.coalesce(1)).write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(root)
    return root


QUERIES["csv_large_file"] = lambda spark, sf: C.read_union(spark, _large_file(spark, sf), types={"o_orderkey": "bigint", "o_totalprice": "double"}, block_bytes=BLOCK).drop("source_file")
ORACLE["csv_large_file"] = """SELECT o_orderkey, o_orderpriority || chr(10) || '"é", ' || repeat('line' || chr(10), o_orderkey % 5) AS note, o_totalprice FROM orders"""

# ---------------------------------------------------------------- manifests

QUERIES["file_manifest"] = lambda spark, sf: MF.file_manifest(spark, packet_files(spark, sf), _TXT).select(
    F.regexp_extract("relative_path", r"^kind_folder=([^/]+)/shard=", 1).alias("kind"), F.regexp_extract("relative_path", r"shard=(\d+)/", 1).alias("shard"), "extension", "file_type", "encoding",
    "sha256", "size_bytes",
)
ORACLE["file_manifest"] = f"WITH {_CONTENTS} SELECT kind, shard, '.txt' AS extension, 'TXT' AS file_type, 'utf-8' AS encoding, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS size_bytes FROM contents"


def _refreshed(spark, sf):
    """A stored manifest with marked digests, without one type and with other sizes for another: only those are read again."""
    root = packet_files(spark, sf)
    fresh = MF.file_manifest(spark, root, _TXT)
    marked = fresh.withColumn("sha256", F.lit("stored")).where(~F.col("path").contains("=view/"))
    stored = stage(marked.withColumn("size_bytes", F.when(F.col("path").contains("=error/"), F.col("size_bytes") - 1).otherwise(F.col("size_bytes"))))
    return MF.refresh_manifest(spark, root, stored, _TXT).select(
        F.regexp_extract("relative_path", r"^kind_folder=([^/]+)/shard=", 1).alias("kind"), F.regexp_extract("relative_path", r"shard=(\d+)/", 1).alias("shard"), "sha256", "size_bytes"
    )


QUERIES["refreshed_manifest"] = _refreshed
ORACLE["refreshed_manifest"] = f"""WITH {_CONTENTS} SELECT kind, shard, CASE WHEN kind IN ('view', 'error') THEN sha256(body) ELSE 'stored' END AS sha256,
 CAST(strlen(body) AS BIGINT) AS size_bytes FROM contents"""

QUERIES["manifest_rows"] = lambda spark, sf: MF.file_manifest(spark, line_files(spark, sf), "*.csv").groupBy(
    F.regexp_extract("relative_path", "^([^/]+)/", 1).alias("original_label"), "columns", "columns_count"
).agg(F.sum("rows").alias("rows"))
ORACLE["manifest_rows"] = """SELECT l_returnflag AS original_label, CASE WHEN l_returnflag = 'N' THEN '["l_quantity","l_tax","l_orderkey","l_linenumber"]' ELSE '["l_orderkey","l_linenumber","l_quantity"]' END AS columns,
 CASE WHEN l_returnflag = 'N' THEN 4::INTEGER ELSE 3::INTEGER END AS columns_count, count(*) AS rows FROM lineitem GROUP BY l_returnflag"""


def _diff(spark, sf):
    """Against a stored list with other sizes for one type, without another type, and with a file that is gone."""
    root = packet_files(spark, sf)
    stored = MF.file_manifest(spark, root, _TXT)
    changed = stored.select("path", F.when(F.col("path").contains("=error/"), F.col("size_bytes") - 1).otherwise(F.col("size_bytes")).alias("size_bytes"))
    then = changed.where(~F.col("path").contains("=view/")).unionByName(
        changed.limit(1).select(F.lit("file:/gone.txt").alias("path"), F.lit(5).cast("bigint").alias("size_bytes"))
    )
    return MF.manifest_diff(C.discover(spark, root, _TXT), then).select(
        F.coalesce(F.nullif(F.regexp_extract("path", r"kind_folder=([^/]+)/", 1), F.lit("")), F.lit("gone")).alias("kind"), "status"
    )


QUERIES["manifest_diff"] = _diff
ORACLE["manifest_diff"] = """SELECT event_type AS kind, CASE event_type WHEN 'error' THEN 'changed' WHEN 'view' THEN 'added' ELSE 'unchanged' END AS status
FROM (SELECT DISTINCT event_type, event_id % 8 FROM events) UNION ALL SELECT 'gone', 'removed'"""

# ---------------------------------------------------------------- stored tables


def _records(spark, sf):
    """Run records written as JSON and read back as one table."""
    path = stage_path(spark, "runs")
    runs = clean_runs(spark, sf)
    TB.write_json(runs.repartition("dataset", "seed"), path)
    return rounded(TB.read_runs(spark, path, runs.schema, multi_line=False).select("dataset", "seed", "accuracy", "f1", "tp"))


QUERIES["json_run_records"] = _records
ORACLE["json_run_records"] = f"WITH {CLEAN_RUNS} SELECT dataset, seed, accuracy, f1, tp FROM clean_runs"


def _parts(spark, sf):
    """Parts with different columns, united by name."""
    path = stage_path(spark, "parts")
    rows = table(spark, sf, "orders")
    rows.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice").write.parquet(f"{path}/part=1")
    rows.where(F.col("o_orderstatus") != "F").select("o_orderpriority", "o_orderkey").write.parquet(f"{path}/part=2")
    return TB.read_parts(spark, path).drop("part")


QUERIES["parquet_parts"] = _parts
ORACLE["parquet_parts"] = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice,
 CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders"""


def _split_store(spark, sf):
    path = stage_path(spark, "splits")
    rows = flows(spark, sf).withColumn("split", F.when(F.col("l_suppkey") % 5 == 0, "test").otherwise("train"))
    TB.write_splits(rows.select("l_orderkey", "y", "split"), path)
    both = TB.union_splits({s: TB.read_split(spark, path, s) for s in ("train", "test")})
    return both.groupBy("split", "y").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys"))


QUERIES["split_store"] = _split_store
ORACLE["split_store"] = """SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y, count(*) AS rows,
 CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY ALL"""


def _scan_once(spark, sf):
    """The second call finds the written table and does not build it again."""
    path = stage_path(spark, "once")
    TB.materialized(spark, path, lambda: flows(spark, sf).select("l_orderkey", "y"))

    def not_again():
        raise AssertionError("built twice")

    return TB.materialized(spark, path, not_again).groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


QUERIES["materialized_once"] = _scan_once
ORACLE["materialized_once"] = "SELECT CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y, count(*) AS rows FROM lineitem GROUP BY ALL"


def _schema(spark, sf):
    """The columns of a table with the number of their values, so that the listing is checked against the data."""
    rows = table(spark, sf, "part")
    filled = rows.select(*[F.count(c).alias(c) for c in rows.columns]).unpivot([], rows.columns, "feature", "present")
    return TB.schema_table(rows).join(filled, "feature")


QUERIES["schema_table"] = _schema
ORACLE["schema_table"] = """WITH types AS (SELECT typeof(p_partkey) AS p_partkey, typeof(p_name) AS p_name, typeof(p_brand) AS p_brand, typeof(p_type) AS p_type, typeof(p_size) AS p_size,
 typeof(p_retailprice) AS p_retailprice FROM part LIMIT 1), kinds AS (UNPIVOT types ON * INTO NAME feature VALUE kind),
 filled AS (UNPIVOT (SELECT count(p_partkey) AS p_partkey, count(p_name) AS p_name, count(p_brand) AS p_brand, count(p_type) AS p_type, count(p_size) AS p_size, count(p_retailprice) AS p_retailprice FROM part) ON * INTO NAME feature VALUE present)
SELECT (list_position(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], feature) - 1)::INTEGER AS position, feature,
 CASE kind WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS dtype, kind <> 'VARCHAR' AS is_numeric, present
 FROM kinds JOIN filled USING (feature)"""
