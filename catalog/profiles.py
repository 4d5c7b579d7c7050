"""Column profiles, value classes and type audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ANY_BAD, FLOWS, MEASUREMENTS, PACKET_NUMERIC, PACKETS, Query, bad_sql, flows, measurements, packets, rounded, table,
)
from flowgate.functions import numbers
from flowgate.operators import profile as P
from flowgate.operators import quantiles, typeaudit
from flowgate.operators import sketches as SK
from flowgate.staging import stage, stage_path

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_MEASURED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "gap", "rate", "ratio", "steady", "rare"]
_NUMERIC = {"l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "gap": "double", "rate": "double",
            "ratio": "double", "steady": "int", "rare": "int"}

QUERIES["table_summary"] = lambda spark, sf: P.table_summary(table(spark, sf, "lineitem")).select(
    "rows", "columns", F.array_join("column_names", ",").alias("column_names"), F.array_join("dtypes", ",").alias("dtypes")
)
ORACLE["table_summary"] = """SELECT count(*) AS rows, CAST(11 AS INTEGER) AS columns,
 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS column_names,
 'bigint,bigint,bigint,int,double,double,double,double,string,string,timestamp_ntz' AS dtypes FROM lineitem"""

QUERIES["label_distribution"] = lambda spark, sf: P.label_distribution(
    table(spark, sf, "events").withColumn("label", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_type"))), "label"
)
ORACLE["label_distribution"] = """SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS label_value, count(*) AS row_count
FROM events GROUP BY ALL"""

QUERIES["binary_distribution"] = lambda spark, sf: P.label_distribution(flows(spark, sf), "y")
ORACLE["binary_distribution"] = f"WITH {FLOWS} SELECT y AS label_value, count(*) AS row_count FROM flows GROUP BY y"

QUERIES["column_profile"] = lambda spark, sf: rounded(P.column_profile(measurements(spark, sf), approximate=False), 4)


def _profile_row(name: str) -> str:
    kind = _NUMERIC.get(name)
    if not kind:
        return f"""SELECT '{name}' AS feature, 'string' AS dtype, count(*) FILTER (WHERE {name} IS NULL) AS missing,
 round(100.0 * count(*) FILTER (WHERE {name} IS NULL) / count(*), 4)::DOUBLE AS missing_pct, NULL::VARCHAR AS analysis_dtype,
 NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std,
 NULL::BIGINT AS positive_inf, NULL::BIGINT AS negative_inf FROM measurements"""
    x = f"CASE WHEN isfinite({name}::DOUBLE) THEN {name}::DOUBLE END"
    return f"""SELECT '{name}' AS feature, '{kind}' AS dtype, count(*) FILTER (WHERE {name} IS NULL) AS missing,
 round(100.0 * count(*) FILTER (WHERE {name} IS NULL) / count(*), 4)::DOUBLE AS missing_pct, '{kind}' AS analysis_dtype,
 round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
 count(*) FILTER (WHERE isinf({name}::DOUBLE) AND {name} > 0) AS positive_inf,
 count(*) FILTER (WHERE isinf({name}::DOUBLE) AND {name} < 0) AS negative_inf FROM measurements"""


ORACLE["column_profile"] = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(_profile_row(c) for c in _MEASURED)



# Sketches differ between engines, so these two return their results without a twin; tests hold them to their error bounds. What the stored
# rows keep exactly, and that the sketched profile keeps its bounds, is compared with SQL.
def _sketched(spark, sf):
    """The sketched profile of all columns, judged: ranks of its quantiles and distinct values are counted exactly and put beside it."""
    rows = measurements(spark, sf)
    found = stage(P.column_profile(rows))
    exact = P.value_summary(rows, _MEASURED).select("feature", "cardinality")
    checks, x = [], {f: numbers.finite(F.col(f)) for f in _NUMERIC}
    for r in found.select("feature", "percentiles_approx").collect():
        inside = F.lit(None).cast("boolean")
        if r.feature in x and r.percentiles_approx:
            n, ranks = F.count(x[r.feature]), []
            for p, q in zip(P.APPROXIMATE_POINTS, r.percentiles_approx, strict=True):
                ranks.append((F.count_if(x[r.feature] <= q) >= (p - 0.001) * n) & (F.count_if(x[r.feature] < q) <= (p + 0.001) * n))
            inside = F.array_min(F.array(*ranks))
        checks.append(F.struct(F.lit(r.feature).alias("feature"), inside.alias("quantiles_close")))
    ranked = rows.agg(F.array(*checks).alias("rows")).select(F.inline("rows"))
    present = F.col("cardinality") - (F.col("missing") > 0).cast("int")
    # five standard errors of 5 %
    close = F.abs(F.col("cardinality_approx") - present) <= 0.25 * present + 1
    # an empty table has no distinct values to count
    judged = found.join(exact, "feature", "left").join(ranked, "feature").withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
    return rounded(judged.select(*found.columns, close.alias("cardinality_close"), "quantiles_close"), 4)


QUERIES["column_profile_sketched"] = lambda spark, sf: _sketched(spark, sf).withColumn("percentiles_approx", F.array_join("percentiles_approx", ";"))
QUERIES["sketched_profile_bounds"] = lambda spark, sf: _sketched(spark, sf).select("feature", "missing", "cardinality_close", "quantiles_close")
ORACLE["sketched_profile_bounds"] = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing, true AS cardinality_close, {'true' if c in _NUMERIC else 'NULL::BOOLEAN'} AS quantiles_close FROM measurements"
    for c in _MEASURED
)


def _stored(spark, sf):
    """Measurements of each return flag as parts of a store that are added one after the other, one of them twice."""
    store, rows = stage_path(spark, "sketches"), measurements(spark, sf)
    for flag in ("A", "N", "R", "N"):
        SK.add_part(rows.where(F.col("l_returnflag") == flag), _MEASURED, flag, store)
    return rounded(SK.profile(spark, store), 4)


QUERIES["stored_profile"] = lambda spark, sf: _stored(spark, sf).drop("cardinality_approx", "percentiles_approx")
ORACLE["stored_profile"] = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
    (lambda x: f"""SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4)::DOUBLE AS missing_pct,
 round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std FROM measurements""")(
        f"CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END" if c in _NUMERIC else "NULL::DOUBLE"
    )
    for c in _MEASURED
)
QUERIES["stored_sketches"] = lambda spark, sf: _stored(spark, sf).select("feature", "cardinality_approx", F.array_join("percentiles_approx", ";").alias("percentiles_approx"))

QUERIES["exact_quantiles"] = lambda spark, sf: rounded(
    quantiles.exact_quantiles(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], P.EXACT_POINTS), 4
)
ORACLE["exact_quantiles"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS probability, round(quantile_cont({c}::DOUBLE, {p}), 4) AS quantile FROM orders"
    for c in ("o_totalprice", "o_custkey") for p in P.EXACT_POINTS
)

QUERIES["value_summary"] = lambda spark, sf: rounded(P.value_summary(measurements(spark, sf), _MEASURED))
ORACLE["value_summary"] = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS cardinality, max(n) AS top_rows, round(max(n)::DOUBLE / sum(n), 6) AS top_share
 FROM (SELECT {c}, count(*) AS n FROM measurements GROUP BY {c})""" for c in _MEASURED
)

QUERIES["feature_kinds"] = lambda spark, sf: P.feature_kinds(
    table(spark, sf, "part").withColumns({"p_flag": F.col("p_size") > 25, "p_zero": F.lit(0), "p_slot": F.col("p_size") % 10}), "p_type"
)
_PART = "(SELECT *, p_size > 25 AS p_flag, 0 AS p_zero, p_size % 10 AS p_slot FROM part)"
ORACLE["feature_kinds"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, c AS cardinality, CASE WHEN c <= 1 THEN 'constant' WHEN c = 2 THEN 'binary'
 WHEN {num} AND c <= 20 THEN 'discrete' WHEN {num} THEN 'continuous' ELSE 'categorical' END AS kind
 FROM (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS c FROM {_PART})"""
    for c, num in [("p_partkey", "true"), ("p_name", "false"), ("p_brand", "false"), ("p_size", "true"), ("p_retailprice", "true"),
                   ("p_flag", "false"), ("p_zero", "true"), ("p_slot", "true")]
)

QUERIES["near_constant"] = lambda spark, sf: rounded(P.near_constant(measurements(spark, sf)))
ORACLE["near_constant"] = f"""WITH {MEASUREMENTS} SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS cardinality, max(n) AS top_rows, round(max(n)::DOUBLE / sum(n), 6) AS top_share
 FROM (SELECT {c}, count(*) AS n FROM measurements GROUP BY {c})""" for c in _MEASURED
) + ") WHERE cardinality > 1 AND cardinality <= 100 AND top_share >= 0.995"

QUERIES["profile_table"] = lambda spark, sf: P.profile_table(measurements(spark, sf), "l_returnflag").select(
    "feature", "dtype", "missing", "infinite", "cardinality", "kind",
    *[F.round(F.element_at("quantiles", F.lit(p)), 4).alias(f"q{int(p * 100)}") for p in P.EXACT_POINTS],
)
ORACLE["profile_table"] = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
    (lambda x, kind, num: f"""SELECT '{c}' AS feature, '{kind}' AS dtype, m AS missing, {'i' if num else 'NULL::BIGINT'} AS infinite,
 {'c' if c != 'l_returnflag' else 'NULL::BIGINT'} AS cardinality,
 {"NULL::VARCHAR" if c == 'l_returnflag' else "CASE WHEN c <= 1 THEN 'constant' WHEN c = 2 THEN 'binary' WHEN c <= 20 THEN 'discrete' ELSE 'continuous' END"} AS kind,
 """ + ", ".join((f"round(q[{j + 1}], 4)" if num else "NULL::DOUBLE") + f" AS q{int(p * 100)}" for j, p in enumerate(P.EXACT_POINTS)) + f"""
 FROM (SELECT count(*) FILTER (WHERE {c} IS NULL) AS m, {f"count(*) FILTER (WHERE isinf({c}::DOUBLE))" if num else "NULL"} AS i,
  {f"quantile_cont({x}, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])" if num else "NULL"} AS q FROM measurements),
 (SELECT count(*) AS c FROM (SELECT DISTINCT {c} FROM measurements))""")(
        f"(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END)", _NUMERIC.get(c, "string"), c in _NUMERIC
    )
    for c in _MEASURED
)

QUERIES["dataset_profile"] = lambda spark, sf: rounded(P.dataset_profile(
    table(spark, sf, "documents").drop("doc_id"), "lang", F.when(F.col("lang") == "en", 0).otherwise(1), ["source"]
))
ORACLE["dataset_profile"] = """SELECT rows, benign_rows, attack_rows, 4 AS columns, duplicate_rows,
 round(100.0 * duplicate_rows / rows, 6)::DOUBLE AS duplicate_pct, 'lang' AS label_column
FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE lang = 'en') AS benign_rows, count(*) FILTER (WHERE lang <> 'en') AS attack_rows FROM documents),
 (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, n_chars))"""

# ---------------------------------------------------------------- type audits

QUERIES["numeric_checks"] = lambda spark, sf: rounded(typeaudit.numeric_checks(packets(spark, sf), PACKET_NUMERIC))
ORACLE["numeric_checks"] = f"WITH {PACKETS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER (WHERE {bad_sql(c)}) AS nonnumeric,
 round(min(try_cast({c} AS DOUBLE)), 6) AS min, round(max(try_cast({c} AS DOUBLE)), 6) AS max FROM packets""" for c in PACKET_NUMERIC
)

QUERIES["type_audit"] = lambda spark, sf: rounded(typeaudit.type_audit(packets(spark, sf), [*PACKET_NUMERIC, "kind"], PACKET_NUMERIC))
ORACLE["type_audit"] = f"WITH {PACKETS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, 'numeric' AS expected_type, count(try_cast({c} AS DOUBLE)) AS actual_numeric_count,
 count(*) FILTER (WHERE {bad_sql(c)}) AS actual_non_numeric_count, round(100.0 * count(*) FILTER (WHERE {bad_sql(c)}) / count(*), 6)::DOUBLE AS non_numeric_pct,
 count(*) FILTER (WHERE {bad_sql(c)} AND regexp_full_match({c}, '(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}')) AS ip_like_count FROM packets"""
    for c in PACKET_NUMERIC
) + """ UNION ALL SELECT 'kind', 'categorical', NULL, NULL, NULL, 0::BIGINT"""

QUERIES["top_bad_tokens"] = lambda spark, sf: typeaudit.top_bad_tokens(packets(spark, sf), PACKET_NUMERIC, limit=3)
ORACLE["top_bad_tokens"] = f"WITH {PACKETS}, t AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS token, count(*) AS n FROM packets WHERE {bad_sql(c)} GROUP BY {c}" for c in PACKET_NUMERIC
) + """), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, token) AS INTEGER) AS rank FROM t)
SELECT feature, token, n, rank FROM r WHERE rank <= 3"""

QUERIES["clean_rows"] = lambda spark, sf: typeaudit.clean_rows(packets(spark, sf), PACKET_NUMERIC)
ORACLE["clean_rows"] = f"WITH {PACKETS} SELECT * FROM packets WHERE NOT {ANY_BAD}"

QUERIES["semantic_clean_report"] = lambda spark, sf: rounded(typeaudit.cleaning_report(packets(spark, sf), PACKET_NUMERIC, "y", "kind"))
ORACLE["semantic_clean_report"] = f"""WITH {PACKETS}, p AS (SELECT y, kind, {ANY_BAD} AS bad FROM packets),
t AS (SELECT count(*) AS rows, count(*) FILTER (WHERE bad) AS rows_removed,
 abs(100.0 * count(*) FILTER (WHERE bad AND y = 0) / count(*) FILTER (WHERE y = 0) - 100.0 * count(*) FILTER (WHERE bad AND y = 1) / count(*) FILTER (WHERE y = 1)) AS shift FROM p),
m AS (SELECT max(share) AS worst FROM (SELECT 100.0 * count(*) FILTER (WHERE bad) / count(*) AS share FROM p GROUP BY kind))
SELECT rows, rows_removed, rows - rows_removed AS clean_rows, round(100.0 * rows_removed / rows, 6)::DOUBLE AS removed_pct,
 round(shift, 6)::DOUBLE AS binary_shift_pp, round(worst, 6)::DOUBLE AS max_class_removed_pct, rows_removed / rows <= 0.01 AS global_pass,
 shift < 0.5 AS binary_balance_pass, worst < 10 AS class_pass FROM t, m"""

QUERIES["feature_removal_step"] = lambda spark, sf: typeaudit.feature_removal(packets(spark, sf), PACKET_NUMERIC)


def _residual(c: str) -> str:
    others = " OR ".join(bad_sql(o) for o in PACKET_NUMERIC if o != c)
    return f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE {bad_sql(c)}) AS nonnumeric, count(*) FILTER (WHERE {ANY_BAD}) AS bad_rows,
 count(*) FILTER (WHERE {others}) AS residual_rows FROM packets"""


ORACLE["feature_removal_step"] = f"WITH {PACKETS}, c AS (" + " UNION ALL ".join(_residual(c) for c in PACKET_NUMERIC) + """)
SELECT feature, nonnumeric, bad_rows, residual_rows,
 row_number() OVER (ORDER BY residual_rows, feature) = 1 AND bad_rows > 0 AS dominant FROM c"""
