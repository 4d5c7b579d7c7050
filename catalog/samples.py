"""Samples, splits, model tables and preprocessing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from catalog.base import (
    FLOWS, ORDER_LINES, PACKET_NUMERIC, PACKETS, ROW, VECTOR, Query, bad_sql, flows, key_sql, order_lines, packets, rounded, table,
)
from flowgate.functions.columns import features_and_target
from flowgate.functions.labels import literal_label
from flowgate.operators import preprocess, sampling
from flowgate.operators.verdicts import keep_listed
from flowgate.plans import materialize as M
from flowgate.plans import prepare as PREP
from flowgate.staging import stage, stage_path

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SAMPLE = 5000
_V = ", ".join(VECTOR)


def quota_sql(rows: str, n: int) -> str:
    """CTEs ``counts`` and ``quota`` over a labelled table."""
    return f"""counts AS (SELECT y, count(*) AS n FROM {rows} GROUP BY y),
 shares AS (SELECT y, n, greatest(1, CAST(round_even({float(n)}::DOUBLE * n / sum(n) OVER (), 0) AS BIGINT)) AS q FROM counts),
 quota AS (SELECT y, n AS rows, CAST(q + CASE WHEN y = max(y) OVER () THEN {n} - sum(q) OVER () ELSE 0 END AS BIGINT) AS quota FROM shares)"""


QUERIES["class_quotas"] = lambda spark, sf: sampling.class_quotas(flows(spark, sf), "y", SAMPLE)
ORACLE["class_quotas"] = f"WITH {FLOWS}, {quota_sql('flows', SAMPLE)} SELECT y, rows, quota FROM quota"

QUERIES["stratified_sample"] = lambda spark, sf: sampling.stratified_sample(flows(spark, sf), "y", SAMPLE, key=ROW)
ORACLE["stratified_sample"] = f"""WITH {FLOWS}, {quota_sql('flows', SAMPLE)},
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key_sql(ROW, 42)}) AS rn FROM flows)
SELECT r.* EXCLUDE (rn) FROM r JOIN quota USING (y) WHERE rn <= quota"""

# One vector per row after deduplication: the sample orders by the vector itself.
QUERIES["dedup_sample"] = lambda spark, sf: sampling.stratified_sample(
    M.model_rows(flows(spark, sf), M.Contract("lines", tuple(VECTOR)), F.col("y")), "binary_target", 3000, key=VECTOR
)
ORACLE["dedup_sample"] = f"""WITH {FLOWS}, d AS (SELECT {_V}, min(y) AS y FROM flows GROUP BY {_V} HAVING count(DISTINCT y) = 1),
{quota_sql('d', 3000)}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key_sql(VECTOR, 42)}) AS rn FROM d)
SELECT {_V}, r.y AS binary_target FROM r JOIN quota USING (y) WHERE rn <= quota"""

QUERIES["group_pack_sample"] = lambda spark, sf: sampling.pack_groups(order_lines(spark, sf), "y", ["l_orderkey"], SAMPLE).select(*ROW, "y")
ORACLE["group_pack_sample"] = f"""WITH {ORDER_LINES}, {quota_sql('order_lines', SAMPLE)},
g AS (SELECT l_orderkey, y, count(*) AS n, {key_sql(['l_orderkey'], 42)} AS k FROM order_lines GROUP BY l_orderkey, y),
p AS (SELECT *, sum(n) OVER (PARTITION BY y ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM g)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y FROM order_lines JOIN p USING (l_orderkey, y) JOIN quota USING (y) WHERE filled <= quota"""

QUERIES["group_pack_shuffled"] = lambda spark, sf: sampling.pack_groups(
    order_lines(spark, sf), "y", ["l_orderkey"], SAMPLE, max_broadcast=0, hot_groups=16
).select(*ROW, "y")
ORACLE["group_pack_shuffled"] = ORACLE["group_pack_sample"]

QUERIES["evaluation_subset"] = lambda spark, sf: sampling.evaluation_subset(flows(spark, sf), "y", 2000, key=ROW).select(*ROW, "y")
ORACLE["evaluation_subset"] = f"""WITH {FLOWS}, c AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM flows GROUP BY y),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key_sql(ROW, 314159)}) AS rn FROM flows)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y FROM r JOIN c USING (y)
WHERE rn <= least(n, CAST(round_even(least(2000, total) * n / total::DOUBLE, 0) AS BIGINT))"""

QUERIES["fixed_sample"] = lambda spark, sf: sampling.fixed_sample(flows(spark, sf), 1024, key=ROW).select(*ROW, "y")
ORACLE["fixed_sample"] = f"""WITH {FLOWS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y FROM flows
ORDER BY {key_sql(ROW, 314159)} LIMIT 1024"""


def _frozen(spark, sf):
    """The keys of a subset are written once; a second run reads the list and filters on it."""
    path = stage_path(spark, "frozen")
    rows = flows(spark, sf)
    sampling.freeze_keys(sampling.evaluation_subset(rows, "y", 2000, key=ROW), ROW, path)
    listed = sampling.freeze_keys(rows, ROW, path)
    return keep_listed(rows, listed, ROW).select(*ROW, "y")


QUERIES["frozen_subset"] = _frozen
ORACLE["frozen_subset"] = ORACLE["evaluation_subset"]

QUERIES["shuffled_rows"] = lambda spark, sf: sampling.shuffled(table(spark, sf, "orders"), key=["o_orderkey"]).select("o_orderkey", "o_orderpriority")
ORACLE["shuffled_rows"] = f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {key_sql(['o_orderkey'], 42)}"

_THIRDS = """CASE WHEN before < round(0.70 * total, 6) THEN 'train' WHEN before < round(0.85 * total, 6) THEN 'validation' ELSE 'test' END AS split"""

QUERIES["row_split"] = lambda spark, sf: sampling.split_rows(flows(spark, sf), "y", key=ROW).select(*ROW, "y", "split")
ORACLE["row_split"] = f"""WITH {FLOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key_sql(ROW, 42)}) - 1 AS before,
 count(*) OVER (PARTITION BY y) AS total FROM flows)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y, {_THIRDS} FROM r"""

_GROUP_SPLIT = f"""placed AS (SELECT l_orderkey, y, n, sum(n) OVER (PARTITION BY y ORDER BY k ROWS UNBOUNDED PRECEDING) - n AS before,
  sum(n) OVER (PARTITION BY y) AS total FROM (SELECT l_orderkey, y, count(*) AS n, {key_sql(['l_orderkey'], 42)} AS k FROM order_lines GROUP BY l_orderkey, y)),
 splits AS (SELECT l_orderkey, y, {_THIRDS} FROM placed)"""


def label_group_split(spark, sf):
    return sampling.split_label_groups(order_lines(spark, sf), "y", ["l_orderkey"])


QUERIES["label_group_split"] = lambda spark, sf: label_group_split(spark, sf).select(*ROW, "y", "split")
ORACLE["label_group_split"] = f"""WITH {ORDER_LINES}, {_GROUP_SPLIT}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y, split FROM order_lines JOIN splits USING (l_orderkey, y)"""

QUERIES["split_metadata"] = lambda spark, sf: sampling.split_metadata(label_group_split(spark, sf), "y")
ORACLE["split_metadata"] = f"""WITH {ORDER_LINES}, {_GROUP_SPLIT}
SELECT split, y, count(*) AS rows FROM order_lines JOIN splits USING (l_orderkey, y) GROUP BY split, y"""

QUERIES["group_split"] = lambda spark, sf: sampling.split_groups(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"]).select(*ROW, "split")
ORACLE["group_split"] = f"""WITH g AS (SELECT DISTINCT l_suppkey, l_linenumber, {key_sql(['l_suppkey', 'l_linenumber'], 42)} AS k FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS before, count(*) OVER () AS total FROM g), s AS (SELECT l_suppkey, l_linenumber, {_THIRDS} FROM r)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, split FROM lineitem JOIN s USING (l_suppkey, l_linenumber)"""

# Splitting by order leaves equal feature vectors on both sides: the overlap shows the leak.
QUERIES["split_overlap"] = lambda spark, sf: sampling.split_overlap(label_group_split(spark, sf), VECTOR)
ORACLE["split_overlap"] = f"""WITH {ORDER_LINES}, {_GROUP_SPLIT},
v AS (SELECT {_V}, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c
 FROM order_lines JOIN splits USING (l_orderkey, y) GROUP BY {_V})
SELECT 'train' AS left_split, 'validation' AS right_split, count(*) FILTER (WHERE a AND b) AS shared_vectors FROM v
UNION ALL SELECT 'train', 'test', count(*) FILTER (WHERE a AND c) FROM v UNION ALL SELECT 'validation', 'test', count(*) FILTER (WHERE b AND c) FROM v"""

# ---------------------------------------------------------------- whole jobs

QUERIES["prepare_table"] = lambda spark, sf: PREP.prepare(
    table(spark, sf, "lineitem"), "l_returnflag", ["N"], 4000, key=ROW
).select(*ROW, "binary_target", "split")
ORACLE["prepare_table"] = f"""WITH {FLOWS}, {quota_sql('flows', 4000)},
s AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key_sql(ROW, 42)}) AS rn FROM flows) f JOIN quota USING (y) WHERE rn <= quota),
r AS (SELECT *, rn - 1 AS before, count(*) OVER (PARTITION BY y) AS total FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y AS binary_target, {_THIRDS} FROM r"""

LINES = M.Contract("lines", ("l_linenumber", "l_quantity", "l_discount", "l_tax"), removed=("l_returnflag", "l_linestatus"), target="l_returnflag", max_rows=6000)
PACKET_CONTRACT = M.Contract(
    "packets", tuple(PACKET_NUMERIC[1:]), categorical=("kind",), removed=("event_id",), target="y",
    duplicate_policy=M.DUPLICATE_AWARE, max_rows=4000, text_numeric=tuple(PACKET_NUMERIC[1:]),
)


QUERIES["model_table"] = lambda spark, sf: M.materialize(flows(spark, sf), LINES, F.col("y")).drop("fingerprint")
ORACLE["model_table"] = f"""WITH {FLOWS}, d AS (SELECT {_V}, min(y) AS y FROM flows GROUP BY {_V} HAVING count(DISTINCT y) = 1),
 c AS (SELECT y, count(*) AS n FROM d GROUP BY y), whole AS (SELECT sum(n) AS n FROM c),
{quota_sql('d', 6000)},
s AS (SELECT d2.* FROM (SELECT *, {key_sql(VECTOR, 42)} AS k, row_number() OVER (PARTITION BY y ORDER BY {key_sql(VECTOR, 42)}) AS rn FROM d) d2
 JOIN quota USING (y) WHERE rn <= quota OR (SELECT n FROM whole) <= 6000),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY k) - 1 AS before, count(*) OVER (PARTITION BY y) AS total FROM s)
SELECT {_V}, y AS binary_target, {_THIRDS} FROM r"""

QUERIES["model_table_whole_groups"] = lambda spark, sf: M.materialize(packets(spark, sf), PACKET_CONTRACT, F.col("y")).groupBy(
    "seq", "port", "kind", "binary_target", "split"
).agg(F.count(F.lit(1)).alias("rows"))
_PK = key_sql(["seq", "port", "kind"], 42)
ORACLE["model_table_whole_groups"] = f"""WITH {PACKETS}, p AS (SELECT * FROM packets WHERE NOT ({" OR ".join(bad_sql(c) for c in PACKET_NUMERIC[1:])})),
okay AS (SELECT seq, port, kind FROM p GROUP BY ALL HAVING count(DISTINCT y) = 1), c0 AS (SELECT p.* FROM p JOIN okay USING (seq, port, kind)),
{quota_sql('c0', 4000)}, g AS (SELECT seq, port, kind, y, count(*) AS n, {_PK} AS k FROM c0 GROUP BY seq, port, kind, y),
f AS (SELECT *, sum(n) OVER (PARTITION BY y ORDER BY n, k ROWS UNBOUNDED PRECEDING) AS filled FROM g),
kept AS (SELECT f.* FROM f JOIN quota USING (y) WHERE filled <= quota),
r AS (SELECT *, sum(n) OVER (PARTITION BY y ORDER BY k ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY y) AS total FROM kept)
SELECT seq, port, kind, y AS binary_target, {_THIRDS}, n AS rows FROM r"""


def _contract(spark, sf):
    """The contract, one row per feature, with what the table holds of it."""
    rows = table(spark, sf, "lineitem")
    held = rows.select(*[F.countDistinct(c).alias(c) for c in LINES.features]).unpivot([], LINES.features, "feature", "distinct_values")
    listed = LINES.table(spark).select(
        "dataset", F.posexplode("features").alias("position", "feature"), "feature_count", F.array_join("removed", ",").alias("removed"),
        "target", "split_strategy", "seed", "config_id",
    )
    return listed.join(held, "feature")


QUERIES["feature_contract"] = _contract
_CONTENT = """{"dataset": "lines", "feature_count": 4, "features": ["l_linenumber", "l_quantity", "l_discount", "l_tax"],
 "removed": ["l_returnflag", "l_linestatus"], "seed": 42, "split_strategy": "deduplicate_then_stratified", "target": "l_returnflag"}""".replace("\n", "")
ORACLE["feature_contract"] = f"""WITH held AS (UNPIVOT (SELECT count(DISTINCT l_linenumber) AS l_linenumber, count(DISTINCT l_quantity) AS l_quantity,
 count(DISTINCT l_discount) AS l_discount, count(DISTINCT l_tax) AS l_tax FROM lineitem) ON * INTO NAME feature VALUE distinct_values)
SELECT 'lines' AS dataset, (list_position(['l_linenumber', 'l_quantity', 'l_discount', 'l_tax'], feature) - 1)::INTEGER AS position, feature, 4::INTEGER AS feature_count,
 'l_returnflag,l_linestatus' AS removed, 'l_returnflag' AS target, 'deduplicate_then_stratified' AS split_strategy, 42::INTEGER AS seed,
 sha256('{_CONTENT}') AS config_id, distinct_values FROM held"""


def _materialization(spark, sf):
    source = flows(spark, sf)
    return M.materialization_report(source.count(), M.materialize(source, LINES, F.col("y")), LINES)


QUERIES["materialization_report"] = _materialization
ORACLE["materialization_report"] = "WITH m AS (" + ORACLE["model_table"] + """)
SELECT 'lines' AS dataset, (SELECT count(*) FROM lineitem) AS original_rows, 4::INTEGER AS features, 42::INTEGER AS seed,
 'deduplicate_then_stratified' AS strategy, split, count(*) AS rows, count(*) FILTER (WHERE binary_target = 0) AS benign_rows,
 count(*) FILTER (WHERE binary_target = 1) AS attack_rows FROM m GROUP BY split"""

# ---------------------------------------------------------------- preprocessing

NUMERIC = ["rate", "l_extendedprice", "gap"]
CATEGORICAL = ["l_returnflag", "o_orderpriority"]


def mixed(spark, sf):
    """Numbers with gaps, infinities and text, and categories with gaps, in three splits; stored, as fitting reads them several times."""
    rows = order_lines(spark, sf)
    line = F.col("l_linenumber")
    return stage(rows.select(
        *ROW, "y", "l_extendedprice",
        F.when(line == 7, "inf").when(line == 6, "bad").otherwise(F.col("l_quantity").cast("string")).alias("rate"),
        F.expr("nullif(l_discount, 0.0D)").alias("gap"),
        F.when(line == 4, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_suppkey") % 4 == 0, "6-UNSEEN").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("l_suppkey") % 4 == 0, "test").otherwise("train").alias("split"),
    ))


MIXED = f"""{ORDER_LINES}, mixed AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y, l_extendedprice,
  CASE WHEN l_linenumber = 7 THEN 'inf' WHEN l_linenumber = 6 THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS rate,
  nullif(l_discount, 0.0) AS gap, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_suppkey % 4 = 0 THEN '6-UNSEEN' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN l_suppkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM order_lines),
 clean AS (SELECT *, CASE WHEN isfinite(try_cast(rate AS DOUBLE)) THEN try_cast(rate AS DOUBLE) END AS c_rate,
  l_extendedprice AS c_l_extendedprice, gap AS c_gap FROM mixed),
 med AS (SELECT """ + ", ".join(f"quantile_cont(c_{c}, 0.5) AS med_{c}" for c in NUMERIC) + """ FROM clean WHERE split = 'train'),
 fit AS (SELECT """ + ", ".join(f"any_value(med_{c}) AS med_{c}, avg(coalesce(c_{c}, med_{c})) AS avg_{c}, stddev_pop(coalesce(c_{c}, med_{c})) AS sd_{c}" for c in NUMERIC) + """
  FROM clean, med WHERE split = 'train'),
 modes AS (SELECT """ + ", ".join(
    f"(SELECT {c} FROM clean WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_{c}" for c in CATEGORICAL
) + ")"


def fitted(spark, sf):
    rows = mixed(spark, sf)
    return rows, preprocess.fit(rows.where(F.col("split") == "train"), NUMERIC, CATEGORICAL)


def _transformed(spark, sf):
    rows, prep = fitted(spark, sf)
    return rounded(prep.transform(rows, [*ROW, "split"]))


QUERIES["preprocess_fit"] = lambda spark, sf: rounded(fitted(spark, sf)[1].parameters(spark)).withColumn("vocabulary", F.array_join("vocabulary", ","))
ORACLE["preprocess_fit"] = f"WITH {MIXED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'numeric' AS kind, round(med_{c}, 6) AS median, round(avg_{c}, 6) AS mean, round(sd_{c}, 6) AS scale, NULL AS mode, NULL AS vocabulary FROM fit"
    for c in NUMERIC
) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{c}', 'categorical', NULL, NULL, NULL, (SELECT mode_{c} FROM modes),
 (SELECT string_agg({c}, ',' ORDER BY {c}) FROM (SELECT DISTINCT {c} FROM clean WHERE split = 'train' AND {c} IS NOT NULL))""" for c in CATEGORICAL
)

VOCABULARY = {"l_returnflag": ["A", "N", "R"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
QUERIES["preprocess_transform"] = _transformed
ORACLE["preprocess_transform"] = f"""WITH {MIXED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, split, """ + ", ".join(
    f'round((coalesce(c_{c}, med_{c}) - avg_{c}) / sd_{c}, 6) AS "numeric__{c}"' for c in NUMERIC
) + ", " + ", ".join(
    f"""CASE WHEN coalesce({c}, mode_{c}) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "categorical__{c}_{v}\"""" for c, vs in VOCABULARY.items() for v in vs
) + " FROM clean, fit, modes"



def _assembled(spark, sf):
    """The transformed columns as one vector, of which each place is summed up."""
    rows, prep = fitted(spark, sf)
    values = prep.assemble(rows, ["split"]).select("split", F.posexplode(vector_to_array("features")).alias("place", "value"))
    return rounded(values.groupBy("split", "place").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), 4)


QUERIES["assembled_features"] = _assembled
_PLACES = [f"(coalesce(c_{c}, med_{c}) - avg_{c}) / sd_{c}" for c in NUMERIC] + [f"CASE WHEN coalesce({c}, mode_{c}) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for c, vs in VOCABULARY.items() for v in vs]
ORACLE["assembled_features"] = f"WITH {MIXED} " + " UNION ALL ".join(
    f"SELECT split, {i}::INTEGER AS place, count(*) AS rows, round(sum({x}), 4) + 0.0 AS total FROM clean, fit, modes GROUP BY split" for i, x in enumerate(_PLACES)
)


def _features_and_target(spark, sf):
    """Features and target taken apart, each summed up on its own."""
    x, y = features_and_target(flows(spark, sf).select("l_quantity", "l_tax", "l_orderkey", "y"), "y", ["l_orderkey"])
    sums = x.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("rows"), F.sum(c).cast("double").alias("total")) for c in x.columns]).alias("r"))
    target = y.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("rows"), F.sum(c).cast("double").alias("total")) for c in y.columns]).alias("r"))
    return rounded(sums.unionByName(target).select(F.inline("r")), 4)


QUERIES["features_and_target"] = _features_and_target
ORACLE["features_and_target"] = f"""WITH {FLOWS} SELECT 'l_quantity' AS column, count(l_quantity) AS rows, round(sum(l_quantity)::DOUBLE, 4) AS total FROM flows
UNION ALL SELECT 'l_tax', count(l_tax), round(sum(l_tax)::DOUBLE, 4) FROM flows UNION ALL SELECT 'y', count(y), sum(y)::DOUBLE FROM flows"""

QUERIES["literal_labels"] = lambda spark, sf: table(spark, sf, "lineitem").select("l_returnflag", literal_label(F.col("l_returnflag"), "N").alias("y")).groupBy("l_returnflag", "y").agg(F.count(F.lit(1)).alias("rows"))
ORACLE["literal_labels"] = "SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y, count(*) AS rows FROM lineitem GROUP BY ALL"

QUERIES["feature_lineage"] = lambda spark, sf: fitted(spark, sf)[1].lineage(spark).select(
    "raw_feature", "transformer", F.array_join("output_features", ";").alias("outputs")
)
ORACLE["feature_lineage"] = " UNION ALL ".join(
    f"SELECT '{c}' AS raw_feature, 'numeric impute+scale' AS transformer, 'numeric__{c}' AS outputs" for c in NUMERIC
) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{c}', 'categorical one-hot', (SELECT string_agg('categorical__{c}_' || {c}, ';' ORDER BY {c}) FROM
 (SELECT DISTINCT {'l_returnflag' if c == 'l_returnflag' else 'o_orderpriority'} FROM {'lineitem' if c == 'l_returnflag' else 'orders'}))""" for c in CATEGORICAL
)


def _indexed(spark, sf):
    """Large vocabularies as sparse vectors: the width, and how many entries the rows of each split carry."""
    rows = mixed(spark, sf).withColumn("l_suppkey", F.col("l_suppkey").cast("string"))
    modes = {"l_suppkey": "0", "o_orderpriority": "1-URGENT"}
    model = preprocess.index_categories(rows.where(F.col("split") == "train"), list(modes), modes)
    out = model.transform(preprocess.impute_modes(rows, modes))
    sums = {f: Summarizer.sum(F.col(f"{f}_vector")).alias(f) for f in modes}
    return out.groupBy("split").agg(*sums.values(), F.count(F.lit(1)).alias("rows")).select(
        "split", F.size(vector_to_array("o_orderpriority")).alias("priority_width"), "rows",
        *[F.aggregate(vector_to_array(f), F.lit(0.0), lambda a, x: a + x).cast("bigint").alias(f"known_{f}") for f in modes],
    )


QUERIES["one_hot_vectors"] = _indexed
ORACLE["one_hot_vectors"] = f"""WITH {MIXED} SELECT split, 5::INTEGER AS priority_width,
 count(*) FILTER (WHERE split = 'train') AS known_l_suppkey, count(*) FILTER (WHERE o_orderpriority <> '6-UNSEEN') AS known_o_orderpriority,
 count(*) AS rows FROM mixed GROUP BY split"""
