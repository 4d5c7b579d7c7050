"""File manifests: sizes, checksums, row counts, encodings, and what changed since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.sources.csv import discover, split_fields
from flowgate.sources.heads import file_heads

# Fixed value: the kinds of files that have an encoding.
TEXT_EXTENSIONS = (".csv", ".txt")


def line_feeds(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, lines): pieces of each file between line feeds. A large file is counted by many tasks."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(paths)
    return text.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))


def file_manifest(spark: SparkSession, root: str, pattern: str = "*", paths: list[str] | None = None) -> DataFrame:
    """One row per file: path, name, size, sha256, data rows, columns and encoding (rows and columns for CSV only).

    ``paths`` restricts the reading to some files below the root. Header lines may have any length and are read in the
    file's own encoding. Empty files are not listed, as Spark does not read them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    listing = reader.load(paths or root).select("path", F.col("length").alias("size_bytes"))
    facts = file_heads(listing, digest=True)
    counted = line_feeds(spark, paths or root, pattern)

    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    is_csv = F.col("extension") == ".csv"
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    columns = split_fields(F.col("header"))
    feeds = F.coalesce("lines", F.lit(0)) - F.when(F.col("ended"), 0).otherwise(1)
    joined = listing.join(facts, "path").join(counted, F.regexp_replace(listing.path, "^file:/*", "/") == F.regexp_replace(counted.path, "^file:/*", "/"), "left").drop(counted.path)
    return joined.withColumns({"file_name": name, "extension": extension}).select(
        "path",
        F.replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(base, F.lit("/")), F.lit("")).alias("relative_path"),
        "file_name", "extension", "size_bytes",
        F.round(F.col("size_bytes") / 2**20, 6).alias("size_mib"), F.round(F.col("size_bytes") / 2**30, 6).alias("size_gib"),
        "sha256", F.upper(F.regexp_replace("extension", r"^\.", "")).alias("file_type"),
        F.when(is_csv, F.greatest(feeds - 1, F.lit(0))).alias("rows"),
        F.when(is_csv, F.size(columns)).alias("columns_count"),
        F.when(is_csv, F.to_json(columns)).otherwise("[]").alias("columns"),
        F.when(F.col("extension").isin(*TEXT_EXTENSIONS), F.col("encoding")).otherwise("").alias("encoding"),
    )


def manifest_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files added, removed, changed in size, or unchanged, against a stored manifest."""
    now = listing.select("path", F.col("size_bytes").alias("size_now"))
    then = manifest.select("path", F.col("size_bytes").alias("size_then"))
    status = (
        F.when(F.col("size_then").isNull(), "added")
        .when(F.col("size_now").isNull(), "removed")
        .when(F.col("size_now").eqNullSafe(F.col("size_then")), "unchanged")
        .otherwise("changed")
    )
    return now.join(then, "path", "full_outer").withColumn("status", status)


def refresh_manifest(spark: SparkSession, root: str, stored: DataFrame, pattern: str = "*") -> DataFrame:
    """The manifest of today: rows of unchanged files are reused, only new and changed files are read."""
    diff = manifest_diff(discover(spark, root, pattern), stored)
    kept = stored.join(diff.where(F.col("status") == "unchanged").select("path"), "path", "left_semi")
    # Paths only: the list of files is what the driver plans a read with.
    todo = [r.path for r in diff.where(F.col("status").isin("added", "changed")).select("path").collect()]
    return kept.unionByName(file_manifest(spark, root, pattern, paths=todo)) if todo else kept
