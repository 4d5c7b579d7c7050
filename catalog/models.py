"""Metrics, leakage audits, perturbations, and models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog.base import (
    DOCUMENTS, FLOWS, ORDER_LINES, ROW, VECTOR, Query, flows, key_sql, order_lines, rounded, scored_documents, table,
)
from catalog.samples import _GROUP_SPLIT, label_group_split
from flowgate.operators import leakage as L
from flowgate.operators import metrics as E
from flowgate.operators import model as T
from flowgate.operators import network as N
from flowgate.operators import preprocess, profile
from flowgate.operators import robustness as R
from flowgate.staging import stage

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- metrics

def rates_sql(r=lambda e: f"round({e}, 6)") -> str:
    """Rates over tp, tn, fp, fn."""
    share = {
        "accuracy": ("tp + tn", "tp + tn + fp + fn"), "precision": ("tp", "tp + fp"), "attack_recall": ("tp", "tp + fn"),
        "f1": ("2 * tp", "2 * tp + fp + fn"), "specificity": ("tn", "tn + fp"), "false_positive_rate": ("fp", "fp + tn"),
        "false_negative_rate": ("fn", "fn + tp"),
    }
    out = [r(_rate(a, b)) + f' AS "{n}"' for n, (a, b) in share.items()]
    return ", ".join([*out, r(_mcc("")) + " AS mcc"])


def _rate(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)::DOUBLE"


def _mcc(p: str) -> str:
    tp, tn, fp, fn = (p + c for c in ("tp", "tn", "fp", "fn"))
    return f"coalesce(({tp}::DOUBLE * {tn} - {fp}::DOUBLE * {fn}) / nullif(sqrt(({tp} + {fp})::DOUBLE * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn})), 0), 0)::DOUBLE"


_RATES = rates_sql()


def counts_sql(rows: str, by: str, pred: str = "pred") -> str:
    return f"""SELECT {by}{', ' if by else ''}count(*) FILTER (WHERE y = 1 AND {pred} = 1) AS tp, count(*) FILTER (WHERE y = 0 AND {pred} = 0) AS tn,
 count(*) FILTER (WHERE y = 0 AND {pred} = 1) AS fp, count(*) FILTER (WHERE y = 1 AND {pred} = 0) AS fn FROM {rows}{' GROUP BY ' + by if by else ''}"""


def ranking_sql(rows: str, by: str, other: str = "NULL", r=lambda e: f"round({e}, 6)") -> str:
    """Exact AUC and average precision over distinct scores."""
    part, keys = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""s AS (SELECT {keys}score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM {rows} GROUP BY {keys}score),
 w AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS above FROM s),
 areas AS (SELECT {keys}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {r('(sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE')} ELSE {other} END AS roc_auc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {r('(sum(pos * tp / above) / sum(pos))::DOUBLE')} ELSE {other} END AS pr_auc FROM w{' GROUP BY ' + by if by else ''})"""


QUERIES["binary_metrics"] = lambda spark, sf: rounded(E.binary_metrics(scored_documents(spark, sf), by=["lang"]))
ORACLE["binary_metrics"] = f"WITH {DOCUMENTS}, c AS ({counts_sql('scored', 'lang')}) SELECT lang, tp, tn, fp, fn, {_RATES} FROM c"

QUERIES["confusion_matrix"] = lambda spark, sf: E.confusion_matrix(scored_documents(spark, sf))
ORACLE["confusion_matrix"] = f"""WITH {DOCUMENTS}, c AS ({counts_sql('scored', '')})
SELECT 0::INTEGER AS actual, tn AS predicted_0, fp AS predicted_1 FROM c UNION ALL SELECT 1, fn, tp FROM c"""

QUERIES["roc_auc_exact"] = lambda spark, sf: rounded(E.ranking_metrics(scored_documents(spark, sf)))
ORACLE["roc_auc_exact"] = f"WITH {DOCUMENTS}, {ranking_sql('scored', '')} SELECT * FROM areas"

QUERIES["ranking_by_language"] = lambda spark, sf: rounded(E.ranking_metrics(scored_documents(spark, sf), by=["lang"], one_class=0.0))
ORACLE["ranking_by_language"] = f"WITH {DOCUMENTS}, {ranking_sql('scored', 'lang', '0.0')} SELECT * FROM areas"

# Scores with heavy ties: 50 quantities over all lines.
_TIED = "tied AS (SELECT l_linestatus AS dataset, y, l_quantity / 50.0::DOUBLE AS score, CASE WHEN l_quantity / 50.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS pred FROM flows)"
QUERIES["scored_metrics"] = lambda spark, sf: rounded(E.scored_metrics(
    flows(spark, sf).select(F.col("l_linestatus").alias("dataset"), "y", (F.col("l_quantity") / 50.0).alias("score")), by=["dataset"]
))
ORACLE["scored_metrics"] = f"""WITH {FLOWS}, {_TIED}, {ranking_sql('tied', 'dataset')}, c AS ({counts_sql('tied', 'dataset')})
SELECT dataset, tp, tn, fp, fn, {_RATES}, roc_auc, pr_auc FROM c JOIN areas USING (dataset)"""


def clean_runs(spark, sf):
    """Runs per (dataset, seed): the line status and the supplier modulo three."""
    rows = flows(spark, sf).select(
        F.col("l_linestatus").alias("dataset"), (F.col("l_suppkey") % 3).cast("int").alias("seed"), "y",
        F.when(F.col("l_partkey") % 400 == 0, F.col("l_tax") * 10).otherwise(F.col("y") * 0.9 + F.col("l_tax")).alias("score"),
    )
    return E.leakage_alarm(E.scored_metrics(rows, by=["dataset", "seed"]))


_RUN_ROWS = """runrows AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM (SELECT l_linestatus AS dataset, CAST(l_suppkey % 3 AS INTEGER) AS seed, y,
  CASE WHEN l_partkey % 400 = 0 THEN l_tax * 10 ELSE y * 0.9::DOUBLE + l_tax END AS score FROM flows))"""


def clean_runs_sql(r=lambda e: f"round({e}, 6)") -> str:
    return f"""{FLOWS}, {_RUN_ROWS}, {ranking_sql('runrows', 'dataset, seed', r=r)}, c AS ({counts_sql('runrows', 'dataset, seed')}),
 clean_runs AS (SELECT dataset, seed, tp, tn, fp, fn, {rates_sql(r)}, roc_auc, pr_auc FROM c JOIN areas USING (dataset, seed))"""


CLEAN_RUNS = clean_runs_sql()

QUERIES["leakage_alarm"] = lambda spark, sf: rounded(clean_runs(spark, sf))
ORACLE["leakage_alarm"] = f"WITH {CLEAN_RUNS} SELECT *, greatest(accuracy, f1, roc_auc, attack_recall) > 0.995 AS leakage_alarm FROM clean_runs"

QUERIES["seed_summary"] = lambda spark, sf: rounded(E.seed_summary(clean_runs(spark, sf), E.METRICS))
ORACLE["seed_summary"] = f"WITH {clean_runs_sql(str)} " + " UNION ALL ".join(
    f"""SELECT dataset, '{m}' AS metric, round(avg("{m}"), 6) AS mean, round(stddev_samp("{m}"), 6) AS std, count(*) AS n FROM clean_runs GROUP BY dataset""" for m in E.METRICS
)

QUERIES["metric_pivot"] = lambda spark, sf: rounded(E.metric_pivot(clean_runs(spark, sf), [0, 1, 2]))
ORACLE["metric_pivot"] = f"WITH {CLEAN_RUNS} SELECT dataset, " + ", ".join(f'max(f1) FILTER (WHERE seed = {s}) AS "{s}"' for s in range(3)) + " FROM clean_runs GROUP BY dataset"

QUERIES["run_metrics_long"] = lambda spark, sf: rounded(E.run_metrics_long(clean_runs(spark, sf), ["dataset", "seed"]))
ORACLE["run_metrics_long"] = f"WITH {CLEAN_RUNS}, a AS (SELECT *, greatest(accuracy, f1, roc_auc, attack_recall) > 0.995 AS leakage_alarm FROM clean_runs) " + " UNION ALL ".join(
    f"""SELECT dataset, seed, '{m}' AS metric, CAST(CAST("{m}" AS DOUBLE) AS DOUBLE) AS value FROM a"""
    for m in ("tp", "tn", "fp", "fn", "accuracy", "precision", "attack_recall", "f1", "specificity", "false_positive_rate", "false_negative_rate", "mcc", "roc_auc", "pr_auc")
) + " UNION ALL SELECT dataset, seed, 'leakage_alarm', CAST(CAST(leakage_alarm AS INTEGER) AS DOUBLE) FROM a"


def history(spark, sf):
    """A loss curve per order status: monthly mean prices stand for epochs."""
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.lit(42).alias("seed"),
        ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("epoch"),
    ).agg(F.avg("o_totalprice").alias("validation_loss"), F.min("o_totalprice").alias("train_loss"))


_HISTORY = """history AS (SELECT o_orderstatus AS dataset, 42::INTEGER AS seed, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
 avg(o_totalprice) AS validation_loss, min(o_totalprice) AS train_loss FROM orders GROUP BY ALL)"""

QUERIES["early_stopping"] = lambda spark, sf: rounded(E.early_stopping(history(spark, sf), ["dataset", "seed"]).withColumn(
    "without_improvement", F.col("without_improvement").cast("bigint")
))
ORACLE["early_stopping"] = f"""WITH {_HISTORY}, b AS (SELECT *, min(validation_loss) OVER w AS prior, row_number() OVER (PARTITION BY dataset ORDER BY epoch) AS i FROM history
 WINDOW w AS (PARTITION BY dataset ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, prior IS NULL OR validation_loss < prior AS improved FROM b),
n AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER r AS best_epoch, min(validation_loss) OVER r AS best_loss,
  i - max(CASE WHEN improved THEN i END) OVER r AS without_improvement FROM m WINDOW r AS (PARTITION BY dataset ORDER BY epoch ROWS UNBOUNDED PRECEDING))
SELECT dataset, seed, epoch, round(validation_loss, 6) AS validation_loss, train_loss, improved, best_epoch, round(best_loss, 6) AS best_loss, without_improvement,
 coalesce(bool_or(without_improvement >= 3) OVER (PARTITION BY dataset ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_stop FROM n"""

QUERIES["convergence"] = lambda spark, sf: rounded(E.convergence(history(spark, sf), ["dataset", "seed"]))
ORACLE["convergence"] = f"""WITH {_HISTORY}, b AS (SELECT dataset, seed, min(validation_loss) AS best_validation_loss, max(epoch) AS epochs_executed,
 max_by(train_loss, epoch) AS final_train_loss, max_by(validation_loss, epoch) AS final_validation_loss FROM history GROUP BY dataset, seed),
e AS (SELECT b.*, (SELECT min(epoch) FROM history h WHERE h.dataset = b.dataset AND h.validation_loss = b.best_validation_loss) AS best_epoch FROM b)
SELECT * REPLACE (round(best_validation_loss, 6) AS best_validation_loss, round(final_validation_loss, 6) AS final_validation_loss), best_epoch = epochs_executed AS possible_epoch_cap_truncation FROM e"""

# ---------------------------------------------------------------- leakage

_SUSPECTS = ["l_quantity", "l_discount", "l_linestatus", "shipped", "marker", "l_partkey"]


def suspects(spark, sf):
    """Lines with a column that gives the label away, and one with unreadable values."""
    rows = flows(spark, sf)
    return rows.withColumns({
        "marker": F.col("y") * 10 + F.col("l_linenumber") % 3, "shipped": F.when(F.col("l_linenumber") == 1, None).otherwise(F.year("l_shipdate")),
    })


_SUSPECT_SQL = f"""{FLOWS}, suspects AS (SELECT *, y * 10 + l_linenumber % 3 AS marker, CASE WHEN l_linenumber = 1 THEN NULL ELSE year(l_shipdate) END AS shipped FROM flows)"""


def _leak_sql(c: str) -> str:
    numeric = c not in ("l_linestatus", "shipped")
    auc = "NULL::DOUBLE"
    if numeric:
        auc = f"""(SELECT round((sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 6) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
 FROM (SELECT {c} AS v, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM suspects GROUP BY {c})))"""
    return f"""SELECT '{c}' AS feature, count(v) AS unique_values, count(*) FILTER (WHERE v IS NOT NULL AND least(n0, n1) = 0) AS exclusive_values,
 round(max(CASE WHEN v IS NOT NULL THEN greatest(n0, n1) / (n0 + n1) END)::DOUBLE, 6) AS max_class_purity, {auc} AS univariate_auc
 FROM (SELECT {c} AS v, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM suspects GROUP BY {c})"""


_LEAK = f"WITH {_SUSPECT_SQL}, leak AS (" + " UNION ALL ".join(_leak_sql(c) for c in _SUSPECTS) + """),
 judged AS (SELECT *, CASE WHEN max_class_purity = 1 AND exclusive_values > 1 THEN 'POTENTIAL_PROXY' ELSE 'NORMAL' END AS status FROM leak)"""


def univariate(spark, sf):
    return rounded(L.univariate_leakage(suspects(spark, sf), _SUSPECTS, "y"))


QUERIES["univariate_leakage"] = univariate
ORACLE["univariate_leakage"] = _LEAK + " SELECT * FROM judged"

QUERIES["value_purity"] = lambda spark, sf: rounded(L.value_purity(suspects(spark, sf), _SUSPECTS, "y").drop("unreadable_rows"))
ORACLE["value_purity"] = _LEAK + " SELECT feature, unique_values, exclusive_values, max_class_purity FROM leak"

QUERIES["proxy_report"] = lambda spark, sf: L.proxy_report(univariate(spark, sf), ["l_linestatus"], top=3)
ORACLE["proxy_report"] = _LEAK + """, ranked AS (SELECT *, CASE WHEN univariate_auc IS NULL THEN NULL ELSE row_number() OVER (ORDER BY abs(univariate_auc - 0.5) DESC NULLS LAST, feature DESC) END AS r FROM judged)
SELECT * EXCLUDE (r), CAST(CASE WHEN r <= 3 THEN r END AS INTEGER) AS predictive_rank,
 CASE WHEN feature = 'l_linestatus' THEN 'CATEGORICAL' ELSE 'NETWORK_MEASUREMENT' END AS semantic_type, true AS inference_available,
 'SCENARIO_ASSOCIATED_BUT_LEGITIMATE' AS proxy_risk, 'KEEP' AS decision, 'Observed traffic/protocol attribute; no target or provenance lineage.' AS reason FROM ranked"""

QUERIES["split_audit"] = lambda spark, sf: L.split_audit(
    label_group_split(spark, sf), [*VECTOR, "l_linestatus"], VECTOR, ["l_returnflag", "l_linestatus", "y"]
).withColumn("forbidden_features", F.array_join("forbidden_features", ","))
_V = ", ".join(VECTOR)
ORACLE["split_audit"] = f"""WITH {ORDER_LINES}, {_GROUP_SPLIT},
v AS (SELECT {_V}, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c
 FROM order_lines JOIN splits USING (l_orderkey, y) GROUP BY {_V})
SELECT 5::INTEGER AS feature_contract_count, 'l_linestatus' AS forbidden_features, count(*) FILTER (WHERE a AND b) AS overlap_train_validation,
 count(*) FILTER (WHERE a AND c) AS overlap_train_test, count(*) FILTER (WHERE b AND c) AS overlap_validation_test, 'FAIL' AS status FROM v"""

POLICY = {
    "remove": ["l_orderkey", "l_returnflag"], "binary": ["l_linestatus"], "categorical": ["l_linenumber"], "mutable": ["l_tax", "l_quantity"],
    "conditional": ["l_extendedprice"], "numeric": ["l_discount", "l_quantity"],
}
_ROLE_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def column_facts(spark, sf):
    rows = table(spark, sf, "lineitem")
    ranges = profile.column_profile(rows, _ROLE_COLUMNS, approximate=False).select("feature", "dtype", "min", "max")
    return ranges.join(profile.value_summary(rows, _ROLE_COLUMNS).select("feature", "cardinality"), "feature")


_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string"}
_FACTS = "facts AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{_TYPES.get(c, 'double')}' AS dtype, {f'min({c})::DOUBLE + 0.0' if _TYPES.get(c) != 'string' else 'NULL::DOUBLE'} AS min,
 {f'max({c})::DOUBLE + 0.0' if _TYPES.get(c) != 'string' else 'NULL::DOUBLE'} AS max, count(DISTINCT {c}) AS cardinality FROM lineitem""" for c in _ROLE_COLUMNS
) + ")"
_ROLE_OF = {"l_orderkey": "remove", "l_returnflag": "remove", "l_linestatus": "binary", "l_linenumber": "categorical", "l_tax": "mutable",
            "l_quantity": "mutable", "l_extendedprice": "conditional", "l_discount": "numeric", "l_partkey": "other"}


def _texts(table_: dict, chosen: dict) -> str:
    return ", ".join(
        "CASE feature " + " ".join(f"WHEN '{c}' THEN '{table_[k][i]}'" for c, k in chosen.items()) + f" END AS {f}" for i, f in enumerate(L.CLASS_FIELDS)
    )


QUERIES["feature_roles"] = lambda spark, sf: L.feature_roles(column_facts(spark, sf), POLICY)
ORACLE["feature_roles"] = f"WITH {_FACTS} SELECT *, {_texts(L.ROLES, _ROLE_OF)} FROM facts"

QUERIES["leakage_decision"] = lambda spark, sf: L.leakage_decisions(L.feature_roles(column_facts(spark, sf), POLICY)).select(
    "feature", "dtype", "cardinality", "decision", "risk", "reason"
)
ORACLE["leakage_decision"] = f"""WITH {_FACTS}, r AS (SELECT *, {_texts(L.ROLES, _ROLE_OF)} FROM facts)
SELECT feature, dtype, cardinality, CASE adversarial_status WHEN 'REMOVE' THEN 'REMOVE' WHEN 'CONDITIONALLY_MUTABLE' THEN 'REVIEW' ELSE 'KEEP' END AS decision,
 CASE adversarial_status WHEN 'REMOVE' THEN 'HIGH' WHEN 'CONDITIONALLY_MUTABLE' THEN 'MEDIUM' ELSE 'LOW' END AS risk, reason FROM r"""

_CLASS_OF = {"l_orderkey": "identifier", "l_returnflag": "target", "l_linestatus": "binary", "l_linenumber": "discrete", "l_tax": "discrete",
             "l_quantity": "discrete", "l_extendedprice": "continuous", "l_discount": "temporal", "l_partkey": "derived"}
QUERIES["semantic_classes"] = lambda spark, sf: L.semantic_classes(
    column_facts(spark, sf), {"target": ["l_returnflag"], "identifier": ["l_orderkey"], "derived": ["l_partkey"], "temporal": ["l_discount"]}
)
ORACLE["semantic_classes"] = f"WITH {_FACTS} SELECT *, {_texts(L.CLASSES, _CLASS_OF)} FROM facts"

_AS_TEXT = ["l_tax", "l_linenumber", "l_extendedprice"]
QUERIES["semantic_classes_text"] = lambda spark, sf: L.semantic_classes(
    column_facts(spark, sf).withColumn("analysis_dtype", F.when(~F.col("feature").isin(_AS_TEXT), "double")),
    {"target": ["l_returnflag"], "identifier": ["l_orderkey"], "derived": ["l_partkey"], "temporal": ["l_discount"]}, text_table=True,
)
ORACLE["semantic_classes_text"] = f"""WITH {_FACTS} SELECT *, CASE WHEN feature NOT IN ({', '.join(f"'{c}'" for c in _AS_TEXT)}) THEN 'double' END AS analysis_dtype,
 {_texts(L.CLASSES, _CLASS_OF | dict.fromkeys(_AS_TEXT, 'categorical'))} FROM facts"""

# ---------------------------------------------------------------- perturbation of a linear scorer

SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ATTACKABLE = [
    R.Attackable("l_quantity", "MUTABLE_DISCRETE", "round_to_integer_and_train_bounds", "whole units that a sender can choose", True),
    R.Attackable("l_extendedprice", "CONDITIONALLY_MUTABLE_PROJECTABLE", "clip_to_train_bounds", "directly projectable amount"),
]
# The scorer's weights over scaled features; the bias puts clean recall near the gate's limit.
WEIGHTS = {"l_quantity": 1.0, "l_extendedprice": 0.8, "l_discount": -0.5, "l_tax": 0.3}
BIAS = 2.3


def _fit(spark, sf):
    rows = flows(spark, sf)
    numeric = preprocess.fit_numeric(rows, SCALED)
    ranges = R.fit_ranges(rows, [n for n in numeric if n.name in {a.feature for a in ATTACKABLE}], [a.feature for a in ATTACKABLE if a.discrete])
    return rows, numeric, ranges


def grid(spark, sf, keep=(), attacks=R.ATTACKS, budgets=R.BUDGETS):
    rows, numeric, ranges = _fit(spark, sf)
    rows = rows.withColumns({"dataset": F.col("l_linestatus"), "seed": (F.col("l_suppkey") % 3).cast("int")})
    return R.attack_grid(rows, "y", R.LinearScorer(WEIGHTS, BIAS), numeric, ranges, ROW, attacks, budgets, keep=keep)


_STATS = "stats AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in SCALED) + " FROM lineitem)"
_Z = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in SCALED)


def _project_sql(z: str, c: str) -> str:
    lo, hi = f"((lo_{c} - m_{c}) / s_{c})", f"((hi_{c} - m_{c}) / s_{c})"
    out = f"greatest(least(greatest(least({z}, z_{c} + e_{c}), z_{c} - e_{c}), {hi}), {lo})"
    return f"((round_even({out} * s_{c} + m_{c}, 0) - m_{c}) / s_{c})" if c == "l_quantity" else out


def _pgd_sql(c: str) -> str:
    slot = [a.feature for a in ATTACKABLE].index(c)
    start = f"(('0x' || substr({key_sql(ROW, '314159/0')}, {1 + 7 * slot}, 7))::BIGINT / 268435456.0::DOUBLE)"
    z = f"z_{c} + ({start} * 2 - 1) * e_{c}"
    for _ in range(R.PGD_STEPS):
        z = _project_sql(f"({z}) - e_{c} * 0.25", c)
    return z


def grid_sql(attacks=R.ATTACKS, budgets=R.BUDGETS) -> str:
    """CTEs up to ``grid``, the rows of every condition with clean and adversarial score."""
    conditions = ", ".join(f"('{a}', {b}::DOUBLE)" for a in attacks for b in budgets)
    moved = [a.feature for a in ATTACKABLE]
    eps = ", ".join(f"budget * ((hi_{c} - lo_{c}) / s_{c}) AS e_{c}" for c in moved)
    new = ", ".join(
        f"CASE WHEN y <> 1 THEN z_{c} WHEN attack = 'FGSM' THEN {_project_sql(f'(z_{c} - e_{c})', c)} ELSE {_pgd_sql(c)} END AS a_{c}" for c in moved
    )
    clean = f"{BIAS}::DOUBLE + " + " + ".join(f"({w}::DOUBLE * z_{c})" for c, w in WEIGHTS.items())
    adv = f"{BIAS}::DOUBLE + " + " + ".join(f"({w}::DOUBLE * {'a' if c in moved else 'z'}_{c})" for c, w in WEIGHTS.items())
    delta = [f"abs(a_{c} - z_{c})" for c in moved]
    return f"""{FLOWS}, {_STATS}, conditions(attack, budget) AS (VALUES {conditions}),
 scaled AS (SELECT *, {_Z} FROM flows, stats), budgets AS (SELECT *, {eps} FROM scaled, conditions), moved AS (SELECT *, {new} FROM budgets),
 scores AS (SELECT *, l_linestatus AS dataset, CAST(l_suppkey % 3 AS INTEGER) AS seed, 1.0 / (1.0 + exp(-({clean}))) AS clean_score, 1.0 / (1.0 + exp(-({adv}))) AS score,
  greatest({', '.join(delta)}) AS linf, sqrt({' + '.join(f'{d} * {d}' for d in delta)}) AS l2, {' + '.join(f'CAST({d} > 0 AS INTEGER)' for d in delta)} AS changed FROM moved),
 grid AS (SELECT *, CASE WHEN clean_score >= 0.5 THEN 1 ELSE 0 END AS cp, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores)"""


QUERIES["attack_map"] = lambda spark, sf: R.attack_map(flows(spark, sf), [*SCALED, "l_linestatus"], SCALED, ATTACKABLE)
ORACLE["attack_map"] = " UNION ALL ".join(
    (lambda a: f"""SELECT '{c}' AS raw_feature, '{'numeric' if c in SCALED else 'categorical'}' AS semantic_type, 'PREDICTOR' AS predictive_status, '{a.status if a else R.IMMUTABLE[0]}' AS adversarial_status,
 {str(bool(a and a.discrete)).lower()} AS discrete, '{a.rule if a else R.IMMUTABLE[1]}' AS projection_rule, {f'min({c}) + 0.0' if c in SCALED else 'NULL::DOUBLE'} AS lower_bound,
 {f'max({c}) + 0.0' if c in SCALED else 'NULL::DOUBLE'} AS upper_bound, {'1' if a and a.discrete else 'NULL'}::INTEGER AS step, 'none' AS dependency_group, '{a.reason if a else R.IMMUTABLE[2]}' AS justification FROM lineitem HAVING count(*) > 0""")(
        next((a for a in ATTACKABLE if a.feature == c), None)
    )
    for c in [*SCALED, "l_linestatus"]
)

QUERIES["attack_map_counts"] = lambda spark, sf: R.attack_map_counts(QUERIES["attack_map"](spark, sf))
ORACLE["attack_map_counts"] = f"""SELECT count(*) AS total_predictive_features, count(*) FILTER (WHERE adversarial_status = 'MUTABLE_CONTINUOUS') AS mutable_continuous,
 count(*) FILTER (WHERE adversarial_status = 'MUTABLE_DISCRETE') AS mutable_discrete,
 count(*) FILTER (WHERE adversarial_status = 'CONDITIONALLY_MUTABLE_PROJECTABLE') AS conditionally_mutable_projectable,
 count(*) FILTER (WHERE adversarial_status <> 'IMMUTABLE') AS attackable_total, count(*) FILTER (WHERE adversarial_status = 'IMMUTABLE') AS immutable FROM ({ORACLE['attack_map']})"""

QUERIES["attack_budget"] = lambda spark, sf: rounded(R.attack_budgets(spark, _fit(spark, sf)[2]))
ORACLE["attack_budget"] = f"WITH {_STATS} " + " UNION ALL ".join(
    f"""SELECT '{a.feature}' AS feature, {b}::DOUBLE AS budget, round({b} * (hi_{a.feature} - lo_{a.feature}) / s_{a.feature}, 6) AS epsilon,
 round((lo_{a.feature} - m_{a.feature}) / s_{a.feature}, 6) AS lower, round((hi_{a.feature} - m_{a.feature}) / s_{a.feature}, 6) AS upper FROM stats"""
    for a in ATTACKABLE for b in R.BUDGETS
)

_PERTURBED = "SELECT " + ", ".join(ROW) + """, y, attack, budget, round(clean_score, 6) AS clean_score, round(score, 6) AS score, round(linf, 6) AS linf, round(l2, 6) AS l2, changed AS changed,
 round(a_l_quantity, 6) AS "adv_l_quantity", round(a_l_extendedprice, 6) AS "adv_l_extendedprice" FROM grid"""

QUERIES["fgsm_linear"] = lambda spark, sf: rounded(grid(spark, sf, ROW, ["FGSM"], [0.05]).drop("violations", "clean_pred", "pred"))
ORACLE["fgsm_linear"] = f"WITH {grid_sql(['FGSM'], [0.05])} {_PERTURBED}"

QUERIES["pgd_linear"] = lambda spark, sf: rounded(grid(spark, sf, ROW, ["PGD"], [0.03]).drop("violations", "clean_pred", "pred"))
ORACLE["pgd_linear"] = f"WITH {grid_sql(['PGD'], [0.03])} {_PERTURBED}"

_BY = "dataset, seed, attack, budget"
RUNS = ["dataset", "seed", "attack", "budget"]


def attack_runs(spark, sf, ranking=False):
    return R.attack_metrics(grid(spark, sf, ["dataset", "seed"]), RUNS, ranking)


def runs_sql(r=lambda e: f"round({e}, 6)") -> str:
    """CTEs up to ``runs``, one row per condition; ``r`` rounds, or leaves as is where more is computed on top."""
    recall, f1 = (f"{_rate('c_tp', 'c_tp + c_fn')} - {_rate('tp', 'tp + fn')}", f"{_rate('2 * c_tp', '2 * c_tp + c_fp + c_fn')} - {_rate('2 * tp', '2 * tp + fp + fn')}")
    accuracy = f"{_rate('c_tp + c_tn', 'subset_N')} - {_rate('tp + tn', 'subset_N')}"
    return grid_sql() + f""", tallies AS (SELECT {_BY}, count(*) AS subset_N,
 count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
 count(*) FILTER (WHERE y = 1 AND cp = 1) AS c_tp, count(*) FILTER (WHERE y = 0 AND cp = 0) AS c_tn, count(*) FILTER (WHERE y = 0 AND cp = 1) AS c_fp, count(*) FILTER (WHERE y = 1 AND cp = 0) AS c_fn,
 count(*) FILTER (WHERE y = 1 AND cp = 1 AND pred = 0) AS evaded, avg(linf) AS linf, avg(l2) AS l2, avg(changed) AS changed, count(*) FILTER (WHERE changed = 0) / count(*) AS still FROM grid GROUP BY {_BY}),
 runs AS (SELECT {_BY}, subset_N, tp, tn, fp, fn, {rates_sql(r)}, {r(_rate('evaded', 'c_tp'))} AS attack_success_rate, {r(_rate('tp', 'tp + fn'))} AS robust_attack_recall,
 {r(recall)} AS clean_to_adv_attack_recall_drop, {r(f1)} AS "clean_to_adv_F1_drop", {r(_mcc('c_') + ' - ' + _mcc(''))} AS "clean_to_adv_MCC_drop",
 {r(accuracy)} AS clean_to_adv_accuracy_drop, {r('linf')} AS "mean_Linf", {r('l2')} AS "mean_L2", {r('changed')} AS mean_changed_features,
 {r('still::DOUBLE')} AS projection_collapse_rate, 0::BIGINT AS semantic_constraint_violations FROM tallies)"""


QUERIES["attack_metrics"] = lambda spark, sf: rounded(attack_runs(spark, sf, ranking=True))
ORACLE["attack_metrics"] = f"WITH {runs_sql()}, {ranking_sql('grid', _BY, '0.0')} SELECT runs.*, roc_auc, pr_auc FROM runs JOIN areas USING ({_BY})"

QUERIES["attack_success"] = lambda spark, sf: rounded(R.attack_metrics(grid(spark, sf), ["attack", "budget"], ranking=False).select(
    "attack", "budget", "subset_N", "attack_success_rate", "robust_attack_recall", "clean_to_adv_attack_recall_drop"
))
ORACLE["attack_success"] = f"""WITH {grid_sql()} SELECT attack, budget, count(*) AS subset_N,
 round({_rate('count(*) FILTER (WHERE y = 1 AND cp = 1 AND pred = 0)', 'count(*) FILTER (WHERE y = 1 AND cp = 1)')}, 6) AS attack_success_rate,
 round({_rate('count(*) FILTER (WHERE y = 1 AND pred = 1)', 'count(*) FILTER (WHERE y = 1)')}, 6) AS robust_attack_recall,
 round(({_rate('count(*) FILTER (WHERE y = 1 AND cp = 1)', 'count(*) FILTER (WHERE y = 1)')} - {_rate('count(*) FILTER (WHERE y = 1 AND pred = 1)', 'count(*) FILTER (WHERE y = 1)')}), 6) AS clean_to_adv_attack_recall_drop
FROM grid GROUP BY attack, budget"""

QUERIES["perturbation_size"] = lambda spark, sf: rounded(R.attack_metrics(grid(spark, sf), ["attack", "budget"], ranking=False).select(
    "attack", "budget", "mean_Linf", "mean_L2", "mean_changed_features", "projection_collapse_rate"
))
ORACLE["perturbation_size"] = f"""WITH {grid_sql()} SELECT attack, budget, round(avg(linf), 6) AS "mean_Linf", round(avg(l2), 6) AS "mean_L2", round(avg(changed), 6) AS mean_changed_features,
 round((count(*) FILTER (WHERE changed = 0) / count(*))::DOUBLE, 6) AS projection_collapse_rate FROM grid GROUP BY attack, budget"""

# Candidates that break every kind of rule, before and after repair.
_CANDIDATES = {"quantity": "l_quantity", "flag": "l_flag", "price": "l_extendedprice"}


def candidates(spark, sf):
    return flows(spark, sf).withColumn("l_flag", (F.col("l_linenumber") % 2).cast("double")).select(
        *ROW, "l_quantity", "l_flag", "l_extendedprice", (F.col("l_quantity") + F.col("l_tax") * 20 - 1).alias("quantity"),
        (F.col("l_flag") + F.col("l_discount") * 8).alias("flag"), (F.col("l_extendedprice") * (F.col("l_tax") + 0.95)).alias("price"),
    )


_CAND_SQL = f"""{FLOWS}, cand AS (SELECT {', '.join(ROW)}, l_quantity, (l_linenumber % 2)::DOUBLE AS l_flag, l_extendedprice, l_quantity + l_tax * 20 - 1 AS quantity,
 (l_linenumber % 2)::DOUBLE + l_discount * 8 AS flag, l_extendedprice * (l_tax + 0.95::DOUBLE) AS price FROM flows)"""
_LOW, _HIGH = {"quantity": 1.0, "price": 1000.0}, {"quantity": 50.0, "price": 90000.0}

QUERIES["enforce_constraints"] = lambda spark, sf: rounded(R.enforce_constraints(
    candidates(spark, sf), _CANDIDATES, immutable=["price"], binary=["flag"], discrete=["quantity"], lower=_LOW, upper=_HIGH
), 4)
ORACLE["enforce_constraints"] = f"""WITH {_CAND_SQL} SELECT {', '.join(ROW)}, l_quantity, l_flag, round(l_extendedprice, 4) AS l_extendedprice,
 round_even(greatest(least(quantity, 50.0::DOUBLE), 1.0::DOUBLE), 0) AS quantity, greatest(least(round_even(flag, 0), 1.0::DOUBLE), 0.0::DOUBLE) AS flag, round(l_extendedprice, 4) AS price FROM cand"""

QUERIES["constraint_violations"] = lambda spark, sf: R.constraint_violations(
    candidates(spark, sf), _CANDIDATES, immutable=["price"], lower=_LOW, upper=_HIGH,
    rules={"price>=quantity": F.col("price") >= F.col("quantity"), "quantity>=original": F.col("quantity") >= F.col("l_quantity")},
)
ORACLE["constraint_violations"] = f"WITH {_CAND_SQL}, v AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"constraint\", count(*) FILTER (WHERE {c}) AS violations FROM cand" for n, c in [
        ("immutable:price", "price IS DISTINCT FROM l_extendedprice"), ("lower:quantity", "quantity < 1"), ("lower:price", "price < 1000"),
        ("upper:quantity", "quantity > 50"), ("upper:price", "price > 90000"), ("rule:price>=quantity", "NOT (price >= quantity)"),
        ("rule:quantity>=original", "NOT (quantity >= l_quantity)"),
    ]
) + ") SELECT *, violations = 0 AS holds FROM v"

# ---------------------------------------------------------------- models on embeddings


def vectors(spark, sf):
    """Class 0 against the rest, split by vector id."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") == 0, 0).otherwise(1).alias("y"), array_to_vector("embedding").alias("features")
    )
    from flowgate.operators.sampling import split_rows

    return split_rows(rows.withColumn("id", F.col("vec_id")), "y", key=["vec_id"]).drop("id")


def _parts(spark, sf):
    staged = stage(vectors(spark, sf))
    return [staged.where(F.col("split") == s) for s in ("train", "validation", "test")]


# What training finds differs between engines, so these four queries return their results without a twin. Their parts are compared with SQL: the
# split here, a step of training, the forward pass and the attacks for networks of fixed weights below.
_SETTINGS = {"batch": 256, "rate": 0.01}


def _trained(spark, sf):
    train, validation, test = _parts(spark, sf)
    network, curve = N.train(train, validation, "y", ["vec_id"], **_SETTINGS)
    return train, test, network, curve


def _mlp_metrics(spark, sf):
    """Exact figures of the best epoch's network on the test rows."""
    _, test, network, curve = _trained(spark, sf)
    found = E.leakage_alarm(E.scored_metrics(N.score(network, test, ["vec_id", "y"])))
    picked = curve.agg(F.min_by("epoch", F.struct("validation_loss", "epoch")).alias("best_epoch"), F.count(F.lit(1)).alias("epochs"))
    return rounded(found.withColumn("_one", F.lit(1)).join(picked.withColumn("_one", F.lit(1)), "_one").drop("_one"))


QUERIES["mlp_train_score"] = _mlp_metrics
QUERIES["mlp_history"] = lambda spark, sf: rounded(_trained(spark, sf)[3])
QUERIES["audit_models"] = lambda spark, sf: rounded(T.audit_models(*_parts(spark, sf)[:2], "y", ["vec_id"]))

QUERIES["vector_split"] = lambda spark, sf: stage(vectors(spark, sf)).groupBy("split", "y").agg(F.count(F.lit(1)).alias("rows"), F.sum("vec_id").alias("ids"))
ORACLE["vector_split"] = f"""WITH v AS (SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS y FROM embeddings),
 placed AS (SELECT vec_id, y, row_number() OVER (PARTITION BY y ORDER BY {key_sql(['vec_id'], 42)}) - 1 AS before, count(*) OVER (PARTITION BY y) AS total FROM v)
SELECT CASE WHEN before < ceil(round(0.70 * total, 6)) THEN 'train' WHEN before < ceil(round(0.85 * total, 6)) THEN 'validation' ELSE 'test' END AS split, y::INTEGER AS y,
 count(*) AS rows, sum(vec_id)::BIGINT AS ids FROM placed GROUP BY ALL"""


def _mlp_attack(spark, sf):
    from pyspark.ml.functions import vector_to_array

    train, test, network, _ = _trained(spark, sf)
    idx = list(range(network.widths[0]))
    ranges = train.select(vector_to_array("features").alias("x")).agg(
        *[f(F.col("x")[i]).alias(f"{n}{i}") for i in idx for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    attacked = T.attack_network(test, network, "y", ["vec_id"], idx, [ranges[f"lo{i}"] for i in idx], [ranges[f"hi{i}"] for i in idx])
    return rounded(R.attack_metrics(stage(attacked), ["attack", "budget"]))


QUERIES["mlp_attack"] = _mlp_attack

# A network of fixed weights: two inputs (tax, and the quantity as a whole number), two hidden units, two classes.
_NET = [[0.9, -1.3], [-0.7, 0.8], [0.2, -0.1], [1.1, -0.6], [-0.9, 1.4], [0.05, -0.05]]
_SCALES = ((0.04, 0.025), (25.0, 15.0))
_NET_LOW, _NET_HIGH = (-1.6, -24 / 15.0), (1.6, 25 / 15.0)


def _network_fgsm(spark, sf):
    (m0, s0), (m1, s1) = _SCALES
    rows = flows(spark, sf).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "y", F.array((F.col("l_tax") - m0) / s0, (F.col("l_quantity") - m1) / s1).alias("features")
    )
    grid = T.attack_network(
        rows, ((2, 2, 2), [w for row in _NET for w in row]), "y", ["l_orderkey", "l_linenumber"], [0, 1], _NET_LOW, _NET_HIGH, attacks=["FGSM"],
        keep=["l_returnflag"], whole={1: _SCALES[1]},
    )
    return rounded(grid.groupBy("l_returnflag", "budget").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("changed").alias("changed"), F.max("linf").alias("linf"), F.avg("score").alias("score"),
        F.avg("clean_score").alias("clean_score"), F.sum("pred").alias("predicted"), F.sum("violations").alias("violations"),
    ))


def _forward_sql(a: str, b: str) -> str:
    """P(class 1) of the fixed network for two inputs."""
    (w00, w01), (w10, w11), (b0, b1), (v00, v01), (v10, v11), (c0, c1) = _NET
    h0, h1 = (f"(1 / (1 + exp(-({a} * ({x}) + {b} * ({y}) + ({c})))))" for x, y, c in ((w00, w10, b0), (w01, w11, b1)))
    return f"(1 / (1 + exp(({h0} * ({v00}) + {h1} * ({v10}) + ({c0})) - ({h0} * ({v01}) + {h1} * ({v11}) + ({c1})))))"


def _gradient_sql(i: int) -> str:
    """Gradient, by input i, of the cross entropy towards class 0, from p (class 1) and the hidden units."""
    terms = [f"(p * ({_NET[3 + j][1] - _NET[3 + j][0]})) * h{j} * (1 - h{j}) * ({_NET[i][j]})" for j in range(2)]
    return f"sign({terms[0]} + {terms[1]})"


QUERIES["network_fgsm"] = _network_fgsm
ORACLE["network_fgsm"] = f"""WITH {FLOWS}, z AS (SELECT l_returnflag, y, (l_tax - 0.04::DOUBLE) / 0.025::DOUBLE AS z0, (l_quantity - 25.0::DOUBLE) / 15.0::DOUBLE AS z1 FROM flows),
 p AS (SELECT *, {_forward_sql('z0', 'z1')} AS p, 1 / (1 + exp(-(z0 * 0.9 + z1 * (-0.7) + 0.2))) AS h0, 1 / (1 + exp(-(z0 * (-1.3) + z1 * 0.8 + (-0.1)))) AS h1 FROM z),
 moved AS (SELECT *, greatest(least(z0 - budget * {_NET_HIGH[0] - _NET_LOW[0]}::DOUBLE * {_gradient_sql(0)}, {_NET_HIGH[0]}::DOUBLE), {_NET_LOW[0]}::DOUBLE) AS a0,
  (round_even(greatest(least(z1 - budget * {_NET_HIGH[1] - _NET_LOW[1]}::DOUBLE * {_gradient_sql(1)}, {_NET_HIGH[1]}::DOUBLE), {_NET_LOW[1]}::DOUBLE) * 15.0::DOUBLE + 25.0::DOUBLE, 0) - 25.0::DOUBLE) / 15.0::DOUBLE AS a1
  FROM p, (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE)) b(budget)),
 x AS (SELECT *, CASE WHEN y = 1 THEN a0 ELSE z0 END AS x0, CASE WHEN y = 1 THEN a1 ELSE z1 END AS x1 FROM moved)
SELECT l_returnflag, budget, count(*) AS rows, CAST(sum(CASE WHEN x0 <> z0 THEN 1 ELSE 0 END + CASE WHEN x1 <> z1 THEN 1 ELSE 0 END) AS BIGINT) AS changed,
 round(max(greatest(abs(x0 - z0), abs(x1 - z1))), 6) AS linf, round(avg({_forward_sql('x0', 'x1')}), 6) AS score, round(avg(p), 6) AS clean_score,
 CAST(sum(CASE WHEN {_forward_sql('x0', 'x1')} >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS predicted,
 CAST(sum(CASE WHEN y = 1 THEN CASE WHEN x0 > {_NET_HIGH[0] + 1e-9}::DOUBLE OR x0 < {_NET_LOW[0] - 1e-9}::DOUBLE THEN 1 ELSE 0 END + CASE WHEN x1 > {_NET_HIGH[1] + 1e-9}::DOUBLE OR x1 < {_NET_LOW[1] - 1e-9}::DOUBLE THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS violations
FROM x GROUP BY l_returnflag, budget"""

# ---------------------------------------------------------------- the specified network with fixed weights

# Two inputs, two rectified units, two classes; matrix by rows, then bias, layer by layer.
_RELU = [0.9, -1.3, -0.7, 0.8, 0.21, 0.43, 1.1, -0.6, -0.9, 1.4, 0.05, -0.05]
_STEP, _MEAN, _SQUARE, _LEARN = 3, 0.01, 0.04, 0.05


def _inputs(spark, sf):
    (m0, s0), (m1, s1) = _SCALES
    return flows(spark, sf).select("l_returnflag", "l_orderkey", "l_linenumber", "y", F.array((F.col("l_tax") - m0) / s0, (F.col("l_quantity") - m1) / s1).alias("features"))


def _network_step(spark, sf):
    """One step of training over all rows: mean gradient, and weights after Adam went on from its fourth step."""
    network = N.Network((2, 2, 2), np.array(_RELU))
    rows = _inputs(spark, sf).select(F.col("features").alias("x"), F.col("y").cast("int").alias("y"), F.xxhash64("l_orderkey", "l_linenumber").alias("h"))
    n, loss, gradient = N.mean_gradient(rows, network)
    flat, _ = N.Adam(_STEP, np.full(len(_RELU), _MEAN), np.full(len(_RELU), _SQUARE)).apply(network.flat, gradient, _LEARN)
    found = [(i, n, loss, float(g), float(w)) for i, (g, w) in enumerate(zip(gradient, flat))]
    return rounded(spark.createDataFrame(found, "parameter int, rows long, loss double, gradient double, weight double"))


_INPUTS = "z AS (SELECT l_returnflag, l_orderkey, l_linenumber, y, (l_tax - 0.04::DOUBLE) / 0.025::DOUBLE AS z0, (l_quantity - 25.0::DOUBLE) / 15.0::DOUBLE AS z1 FROM flows)"


def _relu_sql(a: str, b: str) -> tuple[str, str, str]:
    """Both hidden units and the difference of the outputs (class 1 less class 0) for two inputs."""
    w = [f"({x}::DOUBLE)" for x in _RELU]
    h0, h1 = (f"greatest({a} * {w[j]} + {b} * {w[2 + j]} + {w[4 + j]}, 0)" for j in range(2))
    return h0, h1, f"({h0} * ({w[7]} - {w[6]}) + {h1} * ({w[9]} - {w[8]}) + ({w[11]} - {w[10]}))"


_H0, _H1, _MARGIN = _relu_sql("z0", "z1")
_TERMS = ["z0 * e0", "z0 * e1", "z1 * e0", "z1 * e1", "e0", "e1", "h0 * d0", "h0 * d1", "h1 * d0", "h1 * d1", "d0", "d1"]
QUERIES["network_step"] = _network_step
ORACLE["network_step"] = f"""WITH {FLOWS}, {_INPUTS}, p AS (SELECT *, {_H0} AS h0, {_H1} AS h1, 1 / (1 + exp(-{_MARGIN})) AS p FROM z),
 d AS (SELECT *, (1 - p) - (y = 0)::INTEGER AS d0, p - (y = 1)::INTEGER AS d1 FROM p),
 e AS (SELECT *, CASE WHEN h0 > 0 THEN d0 * ({_RELU[6]}::DOUBLE) + d1 * ({_RELU[7]}::DOUBLE) ELSE 0 END AS e0, CASE WHEN h1 > 0 THEN d0 * ({_RELU[8]}::DOUBLE) + d1 * ({_RELU[9]}::DOUBLE) ELSE 0 END AS e1 FROM d),
 m AS (SELECT count(*) AS rows, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS loss, [{', '.join(f'avg({t})' for t in _TERMS)}] AS g FROM e),
 g AS (SELECT rows, loss, g, least(1.0::DOUBLE, 5.0::DOUBLE / (sqrt(list_sum(list_transform(g, lambda x: x * x))) + 1e-6)) AS cut FROM m),
 v AS (SELECT unnest(range(12)) AS i, unnest(g) AS gradient, unnest([{', '.join(f'{x}::DOUBLE' for x in _RELU)}]) AS w, rows, loss, cut FROM g)
SELECT i::INTEGER AS parameter, rows, round(loss, 6) AS loss, round(gradient, 6) AS gradient,
 round(w - {_LEARN} * ((0.9 * {_MEAN} + 0.1 * cut * gradient) / (1 - pow(0.9::DOUBLE, {_STEP + 1}))) / (sqrt((0.999 * {_SQUARE} + 0.001 * pow(cut * gradient, 2)) / (1 - pow(0.999::DOUBLE, {_STEP + 1}))) + 1e-8), 6) AS weight
FROM v"""


def _network_pgd(spark, sf):
    """Both attacks on the network of rectified units, iterated steps from random starts included."""
    grid = T.attack_network(_inputs(spark, sf), N.Network((2, 2, 2), np.array(_RELU)), "y", ["l_orderkey", "l_linenumber"], [0, 1], _NET_LOW, _NET_HIGH, budgets=[0.03], keep=["l_returnflag"])
    return rounded(grid.groupBy("l_returnflag", "attack").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("changed").alias("changed"), F.avg("linf").alias("linf"), F.avg("l2").alias("l2"), F.avg("score").alias("score"), F.avg("clean_score").alias("clean_score"),
        F.sum("pred").alias("predicted"),
    ))


def _towards(a: str, b: str) -> list[str]:
    """Sign of the gradient, by each input, of the cross entropy towards class 0."""
    h0, h1, _ = _relu_sql(a, b)
    rise = [_RELU[7] - _RELU[6], _RELU[9] - _RELU[8]]
    return [f"sign(CASE WHEN {h0} > 0 THEN {_RELU[2 * i] * rise[0]!r}::DOUBLE ELSE 0 END + CASE WHEN {h1} > 0 THEN {_RELU[2 * i + 1] * rise[1]!r}::DOUBLE ELSE 0 END)" for i in range(2)]


def _moves_sql(steps: int) -> str:
    """Tables s1, s2, ... of the inputs after each step, for rows (z0, z1) that have come to (x0, x1) and move by (l0, l1) within (e0, e1)."""
    parts = []
    for k in range(1, steps + 1):
        toward = _towards("x0", "x1")
        now = [f"CASE WHEN last >= {k} AND y = 1 THEN greatest(least(least(greatest(x{i} - l{i} * {toward[i]}, z{i} - e{i}), z{i} + e{i}), {_NET_HIGH[i]!r}::DOUBLE), {_NET_LOW[i]!r}::DOUBLE) ELSE x{i} END AS x{i}" for i in range(2)]
        parts.append(f"s{k} AS MATERIALIZED (SELECT * REPLACE ({', '.join(now)}) FROM s{k - 1})")
    return ",\n ".join(parts)


def _start_sql(i: int) -> str:
    return f"(('0x' || substr({key_sql(['l_orderkey', 'l_linenumber'], f'{R.ATTACK_SEED}/0')}, {1 + 7 * i}, 7))::BIGINT / 268435456.0::DOUBLE)"


_WIDTHS = [0.03 * (_NET_HIGH[i] - _NET_LOW[i]) for i in range(2)]
QUERIES["network_pgd"] = _network_pgd
ORACLE["network_pgd"] = f"""WITH {FLOWS}, {_INPUTS}, attacks(attack, last, part) AS (VALUES ('FGSM', 1, 1.0::DOUBLE), ('PGD', {R.PGD_STEPS}, {R.PGD_STEP_FRACTION}::DOUBLE)),
 b AS (SELECT *, {', '.join(f'{w!r}::DOUBLE AS e{i}, {w!r}::DOUBLE * part AS l{i}, {_start_sql(i)} AS u{i}' for i, w in enumerate(_WIDTHS))} FROM z, attacks),
 s0 AS (SELECT *, {', '.join(f"CASE WHEN y = 1 AND attack = 'PGD' THEN z{i} + (2 * u{i} - 1) * e{i} ELSE z{i} END AS x{i}" for i in range(2))} FROM b),
 {_moves_sql(R.PGD_STEPS)},
 done AS (SELECT *, abs(x0 - z0) AS c0, abs(x1 - z1) AS c1, 1 / (1 + exp(-{_MARGIN})) AS clean_score, 1 / (1 + exp(-{_relu_sql('x0', 'x1')[2]})) AS score FROM s{R.PGD_STEPS})
SELECT l_returnflag, attack, count(*) AS rows, CAST(sum((c0 > 0)::INTEGER + (c1 > 0)::INTEGER) AS BIGINT) AS changed, round(avg(greatest(c0, c1)), 6) AS linf, round(avg(sqrt(c0 * c0 + c1 * c1)), 6) AS l2,
 round(avg(score), 6) AS score, round(avg(clean_score), 6) AS clean_score, CAST(sum((score >= 0.5)::INTEGER) AS BIGINT) AS predicted FROM done GROUP BY l_returnflag, attack"""
