"""Raw CSV trees: union by column name, structural validation, probes.

Quotes inside a quoted field are doubled; a quoted field may hold line breaks. A file of up to ``block_bytes`` is parsed front to back by one
task. Larger ones are shared by many tasks, block by block (see ``blocks.py``), with the same result; only a file that has quotes in odd places, where the
meaning of one depends on all bytes before it, stays with one task whatever its size. ``multi_line=False`` says that records are single lines, which Spark
splits by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgate.functions.numbers import share
from flowgate.sources.blocks import BLOCK_BYTES, counted_blocks, placed_blocks, records_of
from flowgate.sources.heads import OTHER, file_heads
from flowgate.staging import stage

CORRUPT = "_corrupt_record"
SOURCE = "source_file"

# A field with the comma before it: stretches without commas and quotes, and quoted stretches.
FIELD = r',((?:[^",]++|"[^"]*+"?+)*+)'
# Fixed value: hits listed by a token probe.
PROBE_HITS = 20


def discover(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Files below a folder that match a name pattern, with their sizes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def headers(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """First record and encoding of every file, from a small read of each."""
    return file_heads(discover(spark, root, pattern)).select(F.col("path").alias(SOURCE), "header", "encoding", "returns", "size")


def records(spark: SparkSession, root: str, pattern: str = "*.csv", multi_line: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All records as raw text (``value``) with their file and their number in it (``line``), the header's being 1.

    Empty lines are counted but are no records. Text is as in the file, quotes included, whatever the number of fields. With ``multi_line=False`` every
    line is a record, even if a quote is open. A file with quotes in odd places is cut at every line feed that has an even number of quotes before it.
    """
    files = headers(spark, root, pattern).select(F.col(SOURCE).alias("path"), F.col("size").alias("size_bytes"), "encoding", "returns")
    counted = stage(counted_blocks(files, block_bytes, multi_line))
    return records_of(stage(placed_blocks(counted)), multi_line).select("value", F.col("path").alias(SOURCE), "line")


def split_fields(line: Column) -> Column:
    """Fields of a CSV record, outer quotes removed and doubled quotes resolved; linear in the length of the record."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))
    return F.transform(
        raw, lambda x: F.when(x.rlike('(?s)^".*"$'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x)
    )


class _Group(NamedTuple):
    """Files with one header and one encoding; the large ones apart."""

    names: tuple[str, ...]
    encoding: str
    files: list[str]
    large: list[tuple[str, int, bool]]


def _header_groups(spark: SparkSession, root: str, pattern: str, multi_line: bool, block_bytes: int) -> list[_Group]:
    """Files by header and encoding. The list of files is what a driver plans with anyway."""
    found = headers(spark, root, pattern).select(SOURCE, "encoding", "returns", "size", split_fields(F.col("header")).alias("names"))
    groups: dict[tuple[tuple[str, ...], str], _Group] = {}
    for r in found.orderBy(SOURCE).collect():
        group = groups.setdefault((tuple(r.names), r.encoding), _Group(tuple(r.names), r.encoding, [], []))
        if multi_line and r["size"] > block_bytes:
            group.large.append((r[SOURCE], r["size"], r.returns))
        else:
            group.files.append(r[SOURCE])
    if not groups:
        raise FileNotFoundError(f"no files like {pattern} below {root}")
    return list(groups.values())


_OPTIONS = {
    "enforceSchema": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": CORRUPT,
    # A pruned parser would not see the fields of a record that nobody selects.
    "columnPruning": False,
}


def _whole_files(spark: SparkSession, files: Sequence[str], names: Sequence[str], encoding: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    reader = spark.read.schema(schema).options(**_OPTIONS, header=True, multiLine=multi_line, encoding="ISO-8859-1" if encoding == OTHER else "UTF-8")
    return reader.csv(list(files)).withColumn(SOURCE, F.col("_metadata.file_path"))


def _by_blocks(spark: SparkSession, group: _Group, block_bytes: int) -> list[DataFrame]:
    """The large files of a group, parsed by many tasks; those with quotes in odd places by one task each."""
    listed = spark.createDataFrame([(f, n, r, group.encoding) for f, n, r in group.large], "path string, size_bytes long, returns boolean, encoding string")
    placed = stage(placed_blocks(stage(counted_blocks(listed, block_bytes))))
    odd = [r.path for r in placed.where("irregular").select("path").distinct().collect()]
    parts = [_whole_files(spark, odd, group.names, group.encoding, True)] if odd else []
    if len(odd) < len(group.large):
        data = records_of(placed.where("not irregular")).where("line > 1")
        # by position: a schema in text form need not quote any name
        schema = ", ".join([*(f"c{i} string" for i in range(len(group.names))), f"{CORRUPT} string"])
        # the parser turns line breaks of the file's own kind into line feeds, inside quotes too
        value = F.when(F.col("returns"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
        parsed = data.select(F.from_csv(value, schema, {k: str(v) for k, v in (_OPTIONS | {"multiLine": True}).items()}).alias("r"), "value", F.col("path").alias(SOURCE))
        raw = F.when(F.col(f"r.{CORRUPT}").isNotNull(), F.col("value")).alias(CORRUPT)
        parts.append(parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(group.names)], raw, SOURCE))
    return parts


def _scan(spark: SparkSession, group: _Group, multi_line: bool, block_bytes: int) -> DataFrame:
    """All data records of a group as text columns, the raw text of those that do not fit in one more column, and their file."""
    parts = [_whole_files(spark, group.files, group.names, group.encoding, multi_line)] if group.files else []
    return reduce(DataFrame.union, parts + (_by_blocks(spark, group, block_bytes) if group.large else []))


def _broken(names: Sequence[str]) -> Column:
    """True for records that do not fit their header.

    The second test is always met. It refers to a data column, because Spark refuses a raw scan that asks for nothing
    but the corrupt record.
    """
    return F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(F.col(f"`{names[0]}`").cast("string")), F.lit(0)) >= 0)


def _field_count(record: Column) -> Column:
    """Commas outside quotes, and one."""
    bare = F.regexp_replace(record, r'"[^"]*+"?+', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("int")


def read_union(spark: SparkSession, root: str, pattern: str = "*.csv", types: Mapping[str, str] | None = None, label_from_folder: str | None = None, multi_line: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Many CSV files as one table, united by column name with NULL padding, plus ``source_file``.

    Files are grouped by header, because one read applies one header to all files by position. Short records
    are padded with NULL; a record with too many fields, or with a value that its type cannot read, raises. Columns
    without a type stay text. ``label_from_folder`` names a column for the parent folder.
    """
    types, parts = types or {}, []
    for group in _header_groups(spark, root, pattern, multi_line, block_bytes):
        # Typed columns are read as text and cast: a short record is no excuse for a value that cannot be read.
        names, scanned = group.names, _scan(spark, group, multi_line, block_bytes)
        long = _broken(names) & (_field_count(F.col(CORRUPT)) > len(names))
        reason = F.concat(F.lit("malformed record in "), F.col(SOURCE), F.lit(": "), F.col(CORRUPT))
        checked = scanned.where(F.when(long, F.raise_error(reason).cast("boolean")).otherwise(F.lit(True)))

        def typed(name: str) -> Column:
            c = F.col(f"`{name}`")
            if name not in types:
                return c
            value = F.trim(c).try_cast(types[name])
            unreadable = F.concat(F.lit("malformed record in "), F.col(SOURCE), F.lit(f": no {types[name]} in column {name}: "), c)
            return F.when(c.isNotNull() & value.isNull(), F.raise_error(unreadable).cast(types[name])).otherwise(value).alias(name)

        parts.append(checked.select(*[typed(n) for n in names], SOURCE))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if label_from_folder:
        out = out.withColumn(label_from_folder, F.element_at(F.split(SOURCE, "/"), -2))
    # Provenance last, like the columns that are united.
    tail = [SOURCE, *([label_from_folder] if label_from_folder else [])]
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in tail], *tail)


def validate(spark: SparkSession, root: str, pattern: str = "*.csv", multi_line: bool = True, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """All-text rows whose field count equals their header's, and the raw records of all others.

    Every data record lands in exactly one of the two tables.
    """
    good, bad = [], []
    for group in _header_groups(spark, root, pattern, multi_line, block_bytes):
        names, scanned = group.names, _scan(spark, group, multi_line, block_bytes)
        good.append(scanned.where(~_broken(names)).drop(CORRUPT))
        rejected = scanned.where(_broken(names))
        bad.append(
            rejected.select(
                SOURCE, F.col(CORRUPT).alias("record"), F.lit(len(names)).alias("expected_fields"),
                _field_count(F.col(CORRUPT)).alias("parsed_fields"),
            )
        )
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)
    columns = [c for c in united.columns if c != SOURCE]
    return united.select(*[F.col(f"`{c}`") for c in columns], SOURCE), reduce(DataFrame.unionByName, bad)


def field_counts(spark: SparkSession, root: str, pattern: str = "*.csv", multi_line: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Histogram of the number of fields per record, for each file; headers left out. Quotes do not matter but for the commas between them."""
    rows = records(spark, root, pattern, multi_line, block_bytes)
    counted = rows.groupBy(SOURCE, _field_count(F.col("value")).alias("fields")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    # The smallest number of a file is its header's, and so is that of the group which the header is in.
    first = counted.groupBy(SOURCE).agg(F.min("line").alias("first"))
    out = counted.join(first, SOURCE)
    return out.select(SOURCE, "fields", (F.col("n") - (F.col("line") == F.col("first")).cast("int")).alias("rows")).where(F.col("rows") > 0)


def parser_report(spark: SparkSession, root: str, pattern: str = "*.csv", multi_line: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per file: total, valid and invalid rows, expected columns, header digest, header equal to the first file's."""
    heads = headers(spark, root, pattern).withColumn("names", split_fields(F.col("header")))
    described = heads.select(SOURCE, F.size("names").alias("expected_columns"), F.array_join("names", ",").alias("joined"))
    canonical = described.agg(F.min_by("joined", SOURCE).alias("joined")).select("joined", F.lit(True).alias("same"))
    described = described.join(F.broadcast(canonical), "joined", "left").select(
        SOURCE, "expected_columns", F.sha2("joined", 256).alias("header_hash"), F.coalesce("same", F.lit(False)).alias("header_matches_canonical")
    )
    found = field_counts(spark, root, pattern, multi_line, block_bytes)
    joined = described.join(found, SOURCE, "left")
    ok = F.col("fields") == F.col("expected_columns")
    return joined.groupBy(SOURCE, "expected_columns", "header_hash", "header_matches_canonical").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("rows_valid"),
        F.coalesce(F.sum(F.when(~ok, F.col("rows"))), F.lit(0)).alias("rows_invalid"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("fields").isNotNull(), F.struct("fields", "rows"))))).alias("observed_column_counts"),
    )


def parser_summary(report: DataFrame) -> DataFrame:
    """Totals over all files, malformed share and number of different headers."""
    out = report.agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows_total").alias("rows_total"), F.sum("rows_valid").alias("rows_valid"),
        F.sum("rows_invalid").alias("rows_invalid"), F.countDistinct("header_hash").alias("header_schema_groups"),
    )
    return out.withColumn("malformed_pct", share(F.col("rows_invalid"), F.col("rows_total")) * 100)


def find_token(spark: SparkSession, root: str, token: str, pattern: str = "*.csv", limit: int = PROBE_HITS, multi_line: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The first records that hold a token as a whole field, by file and number, with expected and found field counts and a prefix.

    ``line`` is the number of the record in its file, the header's being 1; a field with line breaks does not count as several lines.
    """
    rows = records(spark, root, pattern, multi_line, block_bytes)
    heads = headers(spark, root, pattern).select(SOURCE, F.size(split_fields(F.col("header"))).alias("expected_fields"))
    fields = split_fields(F.col("value"))
    hits = rows.where(F.col("value").contains(token)).withColumn("fields", fields).where(F.array_contains("fields", token) & (F.col("line") > 1))
    return hits.join(heads, SOURCE).select(
        SOURCE, "line", "expected_fields", F.size("fields").alias("parsed_fields"), F.slice("fields", 1, 10).alias("row_prefix"), F.col("value").alias("record"),
    ).orderBy(SOURCE, "line").limit(limit)
