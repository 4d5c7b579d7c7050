"""Labelled tables that the registered queries run on, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.functions.labels import binary_label

Query = Callable[[SparkSession, str], DataFrame]

# A feature vector with many copies and label conflicts, and columns that identify a row.
VECTOR = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines which add in a different order agree."""
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def key_sql(columns: Sequence[str], seed: object, prefix: str = "") -> str:
    """SQL text of ``order_key`` for columns without negative zeros."""
    parts = ", ".join(f"coalesce(replace(replace(CAST({prefix}{c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '\\N')" for c in columns)
    return f"md5(concat_ws('|', {parts}, '{seed}'))"


# ---------------------------------------------------------------- lineitem as a labelled flow table

def flows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("y", binary_label(F.col("l_returnflag"), ["N"]))


FLOWS = "flows AS (SELECT *, CASE WHEN lower(trim(l_returnflag)) IN ('n') THEN 0 ELSE 1 END AS y FROM lineitem)"
_VECTOR = ", ".join(VECTOR)
GROUPS = f"""{FLOWS}, cells AS (SELECT {_VECTOR}, y, count(*) AS n FROM flows GROUP BY ALL),
 groups AS (SELECT {_VECTOR}, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM cells GROUP BY {_VECTOR})"""


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a label that is constant per order."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("y"), "o_orderpriority"
    )
    return table(spark, sf, "lineitem").join(orders, "l_orderkey")


ORDER_LINES = """order_lines AS (SELECT l.*, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS y, o_orderpriority
 FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""


# ---------------------------------------------------------------- lineitem with missing, infinite and constant values

def measurements(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
        F.expr("nullif(l_discount, 0.0D)").alias("gap"),
        F.when(line == 7, F.lit(float("inf"))).when((line == 6) & (F.col("l_tax") == 0), F.lit(float("-inf"))).otherwise(F.col("l_quantity")).alias("rate"),
        F.when(line == 5, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("ratio"),
        F.lit(1).alias("steady"),
        F.when(F.col("l_orderkey") % 1000 == 0, 1).otherwise(0).alias("rare"),
    )


MEASUREMENTS = """measurements AS (SELECT l_linenumber, l_quantity, l_extendedprice, l_returnflag,
  nullif(l_discount, 0.0) AS gap,
  CASE WHEN l_linenumber = 7 THEN 'inf'::DOUBLE WHEN l_linenumber = 6 AND l_tax = 0 THEN '-inf'::DOUBLE ELSE l_quantity END AS rate,
  CASE WHEN l_linenumber = 5 THEN 'nan'::DOUBLE ELSE l_tax END AS ratio,
  1 AS steady, CASE WHEN l_orderkey % 1000 = 0 THEN 1 ELSE 0 END AS rare FROM lineitem)"""


# ---------------------------------------------------------------- events as an all-text packet table with bad tokens

PACKET_NUMERIC = ["size", "seq", "port"]


def packets(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(e % 97 == 0, F.concat(F.lit("192.168.0."), (F.col("user_id") % 5).cast("string")))
        .when(e % 53 == 0, "-").when(e % 41 == 0, None).otherwise(F.col("value").cast("string")).alias("size"),
        F.when(e % 89 == 0, "n/a").when(e % 97 == 0, "-").otherwise(F.regexp_extract("props", r"(\d+)", 1)).alias("seq"),
        F.when(e % 101 == 0, "0x1F").otherwise(F.col("user_id").cast("string")).alias("port"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0).alias("y"),
    )


PACKETS = r"""packets AS (SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN '192.168.0.' || CAST(user_id % 5 AS VARCHAR) WHEN event_id % 53 = 0 THEN '-'
       WHEN event_id % 41 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS size,
  CASE WHEN event_id % 89 = 0 THEN 'n/a' WHEN event_id % 97 = 0 THEN '-' ELSE regexp_extract(props, '(\d+)', 1) END AS seq,
  CASE WHEN event_id % 101 = 0 THEN '0x1F' ELSE CAST(user_id AS VARCHAR) END AS port,
  event_type AS kind, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS y FROM events)"""


def bad_sql(column: str) -> str:
    return f"({column} IS NOT NULL AND try_cast({column} AS DOUBLE) IS NULL)"


ANY_BAD = "(" + " OR ".join(bad_sql(c) for c in PACKET_NUMERIC) + ")"


# ---------------------------------------------------------------- documents with a truth and a score

def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(
        "doc_id", "lang", F.col("quality").alias("y"), (F.col("n_chars") / F.lit(20000.0)).alias("score"),
        (F.col("n_chars") >= 600).cast("int").alias("pred"),
    )


DOCUMENTS = """scored AS (SELECT doc_id, lang, quality AS y, n_chars / 20000.0::DOUBLE AS score,
  CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id))"""
