"""Duplicates, label conflicts, and what is left after resolving them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FLOWS, GROUPS, VECTOR, Query, flows, rounded, table
from flowgate.functions.labels import binary_label, integer_label
from flowgate.operators import duplicates as D
from flowgate.operators.verdicts import drop_conflicts, keep_listed

_V = ", ".join(VECTOR)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_AUDIT = """CAST(sum(n) AS BIGINT) AS rows_total, count(*) AS unique_feature_vectors,
 count(*) FILTER (WHERE n > 1) AS duplicate_groups,
 CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups,
 round(coalesce(avg(n) FILTER (WHERE n > 1), 0.0), 6) AS mean_duplicate_group_size,
 CAST(coalesce(max(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS max_duplicate_group_size,
 count(*) FILTER (WHERE k > 1) AS cross_label_duplicate_groups,
 CAST(coalesce(sum(n) FILTER (WHERE k > 1), 0) AS BIGINT) AS cross_label_duplicate_rows,
 CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1 AND k = 1), 0) AS BIGINT) AS within_label_duplicate_rows,
 CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
 round(100.0 * (sum(n) - count(*)) / sum(n), 6)::DOUBLE AS duplicate_rows_pct,
 round(100.0 * coalesce(sum(n) FILTER (WHERE k > 1), 0) / sum(n), 6)::DOUBLE AS cross_label_duplicate_pct"""


def groups(spark, sf):
    return D.vector_groups(flows(spark, sf), VECTOR, "y")


QUERIES["duplicate_conflicts"] = lambda spark, sf: rounded(D.duplicate_audit(groups(spark, sf)))
ORACLE["duplicate_conflicts"] = f"WITH {GROUPS} SELECT {_AUDIT} FROM groups"

QUERIES["duplicate_label_summary"] = lambda spark, sf: D.label_summary(groups(spark, sf))
ORACLE["duplicate_label_summary"] = f"""WITH {GROUPS}
SELECT c.y AS binary_label, CAST(sum(c.n) AS BIGINT) AS original_rows, count(*) FILTER (WHERE k = 1) AS deduplicated_rows,
 CAST(coalesce(sum(c.n) FILTER (WHERE k > 1), 0) AS BIGINT) AS conflicting_rows
FROM cells c JOIN groups USING ({_V}) GROUP BY c.y"""

QUERIES["vector_labels"] = lambda spark, sf: D.vector_labels(
    D.vector_groups(flows(spark, sf), VECTOR, "y", exact_key=True)
).select(*VECTOR, "n", F.array_join("labels", ",").alias("labels"))
ORACLE["vector_labels"] = f"""WITH {GROUPS}
SELECT {_V}, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS labels FROM cells GROUP BY {_V}"""

# A key that covers only some of the features, over a table whose class has five values.
QUERIES["feature_group_audit"] = lambda spark, sf: rounded(D.duplicate_audit(D.vector_groups(
    table(spark, sf, "events").withColumn("y", binary_label(F.col("event_type"), [" View", "CLICK"])), ["user_id", "props"], "y"
)))
ORACLE["feature_group_audit"] = f"""WITH cells AS (SELECT user_id, props, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS y, count(*) AS n
 FROM events GROUP BY ALL), groups AS (SELECT user_id, props, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM cells GROUP BY ALL)
SELECT {_AUDIT} FROM groups"""

QUERIES["exact_duplicates"] = lambda spark, sf: rounded(
    D.exact_duplicates(table(spark, sf, "documents").drop("doc_id"), provenance=["source"])
)
ORACLE["exact_duplicates"] = """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang, n_chars)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
 round(100.0 * sum(n - 1) / sum(n), 6)::DOUBLE AS duplicate_pct FROM g"""

QUERIES["duplicates_by_source"] = lambda spark, sf: D.duplicates_by(table(spark, sf, "documents"), "source", excluded=["doc_id"])
ORACLE["duplicates_by_source"] = """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source, text, lang, n_chars HAVING count(*) > 1)
SELECT source, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g GROUP BY source"""

QUERIES["duplicates_by_class"] = lambda spark, sf: D.duplicates_by(
    table(spark, sf, "lineitem").select(*VECTOR, "l_returnflag"), "l_returnflag"
)
ORACLE["duplicates_by_class"] = f"""WITH g AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, {_V} HAVING count(*) > 1)
SELECT l_returnflag, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g GROUP BY l_returnflag"""

QUERIES["dedup_consistent"] = lambda spark, sf: D.deduplicate(flows(spark, sf), VECTOR, "y")
ORACLE["dedup_consistent"] = f"""WITH {FLOWS}
SELECT {_V}, min(y) AS y, count(*) AS copies FROM flows GROUP BY {_V} HAVING count(DISTINCT y) = 1"""

# The vector covers more columns than the model sees: the smallest feature row stands for it.
QUERIES["dedup_representative"] = lambda spark, sf: D.deduplicate(
    flows(spark, sf), ["l_quantity", "l_extendedprice"], "y", identity=["l_partkey", "l_linenumber"]
)
ORACLE["dedup_representative"] = f"""WITH {FLOWS}, g AS (SELECT min(row(l_quantity, l_extendedprice)) AS r, min(y) AS y, count(*) AS copies
 FROM flows GROUP BY l_partkey, l_linenumber HAVING count(DISTINCT y) = 1)
SELECT r[1] AS l_quantity, r[2] AS l_extendedprice, y, copies FROM g"""

QUERIES["drop_conflicts"] = lambda spark, sf: drop_conflicts(flows(spark, sf), VECTOR, "y")
ORACLE["drop_conflicts"] = f"WITH {GROUPS} SELECT f.* FROM flows f JOIN groups USING ({_V}) WHERE k = 1"

# The same rows with the broadcast limit set so low that the shuffled, skew-proof way is taken.
QUERIES["drop_conflicts_shuffled"] = lambda spark, sf: drop_conflicts(flows(spark, sf), VECTOR, "y", max_broadcast=0)
ORACLE["drop_conflicts_shuffled"] = ORACLE["drop_conflicts"]

QUERIES["rows_of_listed_keys"] = lambda spark, sf: keep_listed(
    table(spark, sf, "lineitem"), table(spark, sf, "part").where(F.col("p_size") >= 25).select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]
)
ORACLE["rows_of_listed_keys"] = "SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 25)"

QUERIES["label_mapping"] = lambda spark, sf: table(spark, sf, "orders").select(
    F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  ")).alias("raw"),
    F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_orderkey") % 3).cast("string").alias("code"),
).select(
    "raw", binary_label(F.col("raw"), ["5-low", "1-URGENT "]).alias("from_list"), binary_label(F.col("code"), [0, "0"]).alias("from_code"),
    integer_label(F.col("code")).alias("from_integer"),
).groupBy("raw", "from_list", "from_code", "from_integer").agg(F.count(F.lit(1)).alias("n"))
ORACLE["label_mapping"] = """WITH o AS (SELECT ' ' || o_orderpriority || '  ' AS raw,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS code FROM orders),
m AS (SELECT raw, CASE WHEN lower(trim(raw)) IN ('5-low', '1-urgent') THEN 0 ELSE 1 END AS from_list,
  CASE WHEN code = '0' THEN 0 ELSE 1 END AS from_code, try_cast(code AS INTEGER) AS from_integer FROM o)
SELECT raw, from_list, from_code, from_integer, count(*) AS n FROM m GROUP BY ALL"""
