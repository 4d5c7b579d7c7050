"""Stored tables and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowgate.functions.columns import named


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def materialized(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written first if no complete write is there."""
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def schema_table(df: DataFrame) -> DataFrame:
    """Column names, types and positions, as the input of generated aggregates."""
    rows = [(i, name, kind, isinstance(df.schema[name].dataType, T.NumericType)) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, dtype string, is_numeric boolean")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet parts with different columns, united by name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """One Parquet folder per split; reading one split skips the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Split tables as one table with a ``split`` column; missing columns are filled with NULL."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no split tables given")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header per part; nested columns are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(named(f.name)).alias(f.name) if isinstance(f.dataType, nested) else named(f.name) for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.json", multi_line: bool = True) -> DataFrame:
    """One table from many per-run JSON records below ``path``; an error if there are none.

    ``multi_line`` reads one formatted record per file, otherwise one record per line.
    """
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    try:
        out = reader.json(path)
    except AnalysisException as missing:
        raise FileNotFoundError(path) from missing
    if not out.inputFiles():
        raise FileNotFoundError(f"{path}/{pattern}")
    return out


def distinct_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.select(*[named(k) for k in key]).distinct()
