"""Gate decisions and reports over the runs of the perturbation grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import VECTOR, Query, rounded, table
from catalog.models import CLEAN_RUNS, RUNS, clean_runs_sql, attack_runs, clean_runs, runs_sql
from flowgate.operators import leakage as L
from flowgate.operators import robustness as R
from flowgate.plans import gate as G
from flowgate.plans import report
from flowgate.staging import stage

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def runs(spark, sf):
    """The run table, with a run time that is derived from the run's size."""
    out = attack_runs(spark, sf).withColumn("runtime_seconds", F.col("subset_N") * F.col("budget") / 1000)
    return stage(out)


def _exact(expression: str) -> str:
    return f"({expression})"


_RUNS = f"WITH {runs_sql(_exact).replace(' runs AS (', ' plain AS (')}, runs AS (SELECT *, subset_N * budget / 1000 AS runtime_seconds FROM plain)"
_WORST = _RUNS + """, first_run AS (SELECT dataset, seed, attack_recall + clean_to_adv_attack_recall_drop AS clean FROM runs
  WHERE attack = 'FGSM' AND budget = 0.01), worst AS (SELECT dataset, seed, any_value(clean) AS clean_attack_recall, min(attack_recall) AS worst_adv_attack_recall,
  max(attack_success_rate) AS "max_ASR", max(clean_to_adv_attack_recall_drop) AS max_recall_drop, CAST(sum(semantic_constraint_violations) AS BIGINT) AS semantic_violations,
  count(*) AS conditions FROM runs JOIN first_run USING (dataset, seed) GROUP BY dataset, seed)"""

QUERIES["gate_worst_case"] = lambda spark, sf: rounded(G.worst_cases(runs(spark, sf)))
ORACLE["gate_worst_case"] = _WORST + ' SELECT dataset, seed, round(clean_attack_recall, 6) AS clean_attack_recall, round(worst_adv_attack_recall, 6) AS worst_adv_attack_recall, round("max_ASR", 6) AS "max_ASR", round(max_recall_drop, 6) AS max_recall_drop, semantic_violations, conditions FROM worst'


def evidence(spark, sf):
    """The split audit of each dataset: one is split by a part of the vector, so that no vector is on both sides, the other by supplier."""
    rows = table(spark, sf, "lineitem")

    def audited(dataset, column):
        split = rows.withColumn("split", F.when(F.col(column) % 5 == 0, "test").otherwise("train"))
        return L.split_audit(split, VECTOR, VECTOR, ["l_returnflag"]).select(
            F.lit(dataset).alias("dataset"), F.col("overlap_train_test").alias("fingerprint_overlap"), (F.size("forbidden_features") > 0).alias("confirmed_leakage")
        )

    return audited("F", "l_linenumber").unionByName(audited("O", "l_suppkey"))


def worst(spark, sf, table_=None):
    return G.worst_cases(runs(spark, sf) if table_ is None else table_).join(evidence(spark, sf), "dataset")


def _overlap_sql(dataset: str, column: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, (SELECT count(*) FROM (SELECT {', '.join(VECTOR)} FROM lineitem GROUP BY ALL
 HAVING bool_or({column} % 5 = 0) AND bool_or({column} % 5 <> 0))) AS fingerprint_overlap, false AS confirmed_leakage"""


_JUDGED = _WORST + f", evidence AS ({_overlap_sql('F', 'l_linenumber')} UNION ALL {_overlap_sql('O', 'l_suppkey')}), judged AS (SELECT * FROM worst JOIN evidence USING (dataset))"

# Tighter limits than the default, so that runs of this table fall on both sides.
POLICY = {**G.POLICY, "thresholds": {"clean_attack_recall_min": 0.9395, "robust_attack_recall_min": 0.90, "attack_success_rate_max": 0.05, "attack_recall_drop_max": 0.042}}


def decided(spark, sf):
    return G.decisions(worst(spark, sf), POLICY, confounded=["F"])


def _codes_sql(t: dict) -> str:
    return f"""concat_ws(';', CASE WHEN NOT clean_attack_recall >= {t['clean_attack_recall_min']} THEN 'BLOCK_LOW_CLEAN_RECALL' END,
 CASE WHEN NOT worst_adv_attack_recall >= {t['robust_attack_recall_min']} THEN 'BLOCK_LOW_ROBUST_RECALL' END,
 CASE WHEN NOT "max_ASR" <= {t['attack_success_rate_max']} THEN 'BLOCK_HIGH_ATTACK_SUCCESS_RATE' END,
 CASE WHEN NOT max_recall_drop <= {t['attack_recall_drop_max']} THEN 'BLOCK_EXCESSIVE_RECALL_DROP' END,
 CASE WHEN NOT (semantic_violations = 0 AND conditions = 6 AND fingerprint_overlap = 0 AND NOT confirmed_leakage) THEN 'BLOCK_ARTIFACT_INTEGRITY' END)"""


_DECIDED = _JUDGED + f""", coded AS (SELECT *, {_codes_sql(POLICY['thresholds'])} AS failed_criteria FROM judged),
 decided AS (SELECT dataset, seed, CASE WHEN failed_criteria = '' THEN 'PASS' ELSE 'BLOCK' END AS decision, clean_attack_recall,
 worst_adv_attack_recall, "max_ASR", max_recall_drop, semantic_violations,
 CASE WHEN dataset = 'F' THEN 'NO_DIRECT_LEAKAGE_WITH_DATASET_CONFOUNDING' ELSE 'NO_EVIDENCE_OF_LEAKAGE' END AS leakage_status, failed_criteria,
 CASE WHEN dataset = 'F' THEN 'WARNING_DATASET_CONFOUNDING' ELSE '' END AS warnings, 'default' AS policy_id,
 sha256('{G.policy_digest(POLICY)}') AS policy_hash, CASE WHEN failed_criteria = '' THEN 'PASS_ALL_CRITERIA' ELSE failed_criteria END AS reason_codes FROM coded)"""

QUERIES["gate_decisions"] = lambda spark, sf: rounded(decided(spark, sf)).withColumn("reason_codes", F.array_join("reason_codes", ";"))
ORACLE["gate_decisions"] = _DECIDED + """ SELECT * REPLACE (round(clean_attack_recall, 6) AS clean_attack_recall, round(worst_adv_attack_recall, 6) AS worst_adv_attack_recall,
 round("max_ASR", 6) AS "max_ASR", round(max_recall_drop, 6) AS max_recall_drop) FROM decided"""

QUERIES["gate_sensitivity"] = lambda spark, sf: G.sensitivity(worst(spark, sf), POLICY, (0.90, 0.905, 0.91), (0.03, 0.035, 0.04))
ORACLE["gate_sensitivity"] = _JUDGED + ", t AS (SELECT r.v::DOUBLE AS robust_attack_recall_min, a.v::DOUBLE AS attack_success_rate_max FROM (VALUES (0.90), (0.905), (0.91)) r(v), (VALUES (0.03), (0.035), (0.04)) a(v))" + f"""
SELECT robust_attack_recall_min, attack_success_rate_max, 'validation_only' AS calibration_source,
 count(*) FILTER (WHERE clean_attack_recall >= {POLICY['thresholds']['clean_attack_recall_min']} AND worst_adv_attack_recall >= robust_attack_recall_min AND "max_ASR" <= attack_success_rate_max
  AND max_recall_drop <= {POLICY['thresholds']['attack_recall_drop_max']} AND semantic_violations = 0 AND conditions = 6 AND fingerprint_overlap = 0 AND NOT confirmed_leakage) AS models_passed FROM judged, t GROUP BY ALL"""

QUERIES["decision_stability"] = lambda spark, sf: rounded(G.stability(decided(spark, sf)))
ORACLE["decision_stability"] = _DECIDED + """, s AS (SELECT dataset, count(*) FILTER (WHERE decision = 'PASS') AS "PASS_seeds", count(*) FILTER (WHERE decision = 'BLOCK') AS "BLOCK_seeds",
 round(avg(clean_attack_recall), 6) AS clean_recall_mean, round(avg(worst_adv_attack_recall), 6) AS worst_adv_recall_mean, round(avg("max_ASR"), 6) AS "ASR_mean" FROM decided GROUP BY dataset)
SELECT *, CASE WHEN "BLOCK_seeds" = 0 THEN 'STABLE_PASS' WHEN "PASS_seeds" = 0 THEN 'STABLE_BLOCK' ELSE 'SEED_SENSITIVE' END AS decision_stability FROM s"""

QUERIES["gate_value_added"] = lambda spark, sf: rounded(G.value_added(decided(spark, sf))).select("dataset", "seed", "decision", "clean_only_decision", "decision_changed")
ORACLE["gate_value_added"] = _DECIDED + """, v AS (SELECT dataset, seed, decision, CASE WHEN clean_attack_recall >= 0.95 THEN 'PASS' ELSE 'BLOCK' END AS clean_only_decision FROM decided)
SELECT *, clean_only_decision <> decision AS decision_changed FROM v"""


def _basic(spark, sf):
    table_ = runs(spark, sf)
    f1 = F.col("f1") + F.col("clean_to_adv_F1_drop")
    models = table_.groupBy("dataset", "seed").agg(
        F.min_by(f1, F.struct("attack", "budget")).alias("clean_f1"),
        F.min_by(F.col("attack_recall") + F.col("clean_to_adv_attack_recall_drop"), F.struct("attack", "budget")).alias("clean_attack_recall"),
        F.min("attack_recall").alias("adversarial_attack_recall"), F.max(F.col("clean_to_adv_F1_drop") / f1).alias("relative_f1_drop"),
    )
    limits = {"min_clean_f1": 0.75, "min_clean_attack_recall": 0.94, "min_adversarial_attack_recall": 0.9, "max_relative_f1_drop": 0.2}
    return rounded(G.basic_gate(models, limits).withColumn("failed_conditions", F.array_join("failed_conditions", ";")))


QUERIES["basic_gate"] = _basic
ORACLE["basic_gate"] = _RUNS + """, c AS (SELECT dataset, seed, f1 + "clean_to_adv_F1_drop" AS clean_f1, attack_recall + clean_to_adv_attack_recall_drop AS clean_attack_recall FROM runs WHERE attack = 'FGSM' AND budget = 0.01),
m AS (SELECT dataset, seed, any_value(clean_f1) AS clean_f1, any_value(clean_attack_recall) AS clean_attack_recall, min(attack_recall) AS adversarial_attack_recall,
 max("clean_to_adv_F1_drop" / (f1 + "clean_to_adv_F1_drop")) AS relative_f1_drop FROM runs JOIN c USING (dataset, seed) GROUP BY dataset, seed),
f AS (SELECT *, concat_ws(';', CASE WHEN clean_f1 < 0.75 THEN 'clean_f1' END, CASE WHEN clean_attack_recall < 0.94 THEN 'clean_attack_recall' END,
 CASE WHEN adversarial_attack_recall < 0.9 THEN 'adversarial_attack_recall' END, CASE WHEN relative_f1_drop > 0.2 THEN 'relative_f1_drop' END) AS failed_conditions FROM m)
SELECT dataset, seed, round(clean_f1, 6) AS clean_f1, round(clean_attack_recall, 6) AS clean_attack_recall, round(adversarial_attack_recall, 6) AS adversarial_attack_recall,
 round(relative_f1_drop, 6) AS relative_f1_drop, failed_conditions, CASE WHEN failed_conditions = '' THEN 'PASS' ELSE 'BLOCK' END AS decision FROM f"""

_EXPR = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _stats_sql(columns, stats) -> str:
    return ", ".join(f'round({_EXPR[s]}("{c}")::DOUBLE, 6) AS "{c}_{s}"' for c in columns for s in stats)


_SUMMARY = [c for c in report.SUMMARY_METRICS]
QUERIES["attack_summary"] = lambda spark, sf: rounded(report.adversarial_summary(runs(spark, sf)), 6)
ORACLE["attack_summary"] = _RUNS + f" SELECT dataset, attack, budget, {_stats_sql(_SUMMARY, ('mean', 'std', 'min', 'max'))} FROM runs GROUP BY dataset, attack, budget"

_RUN_NUMERIC = ["seed", "subset_N", "tp", "tn", "fp", "fn", "accuracy", "precision", "attack_recall", "f1", "specificity", "false_positive_rate", "false_negative_rate", "mcc",
                "attack_success_rate", "robust_attack_recall", "clean_to_adv_attack_recall_drop", "clean_to_adv_F1_drop", "clean_to_adv_MCC_drop", "clean_to_adv_accuracy_drop",
                "mean_Linf", "mean_L2", "mean_changed_features", "projection_collapse_rate", "semantic_constraint_violations", "runtime_seconds"]
QUERIES["adversarial_table"] = lambda spark, sf: rounded(report.adversarial_table(runs(spark, sf)), 6)
ORACLE["adversarial_table"] = _RUNS + f" SELECT dataset, attack, budget, {_stats_sql(_RUN_NUMERIC, ('mean', 'std'))} FROM runs GROUP BY dataset, attack, budget"

_CLEAN_NUMERIC = ["seed", "tp", "tn", "fp", "fn", "accuracy", "precision", "attack_recall", "f1", "specificity", "false_positive_rate", "false_negative_rate", "mcc", "roc_auc", "pr_auc"]
QUERIES["clean_table"] = lambda spark, sf: rounded(report.clean_table(clean_runs(spark, sf)), 6)
ORACLE["clean_table"] = f"WITH {clean_runs_sql(_exact)} SELECT dataset, {_stats_sql(_CLEAN_NUMERIC, ('mean', 'std'))} FROM clean_runs GROUP BY dataset"

QUERIES["budget_response"] = lambda spark, sf: rounded(report.budget_response(runs(spark, sf)), 6)
ORACLE["budget_response"] = _RUNS + " SELECT dataset, attack, budget, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in report.BUDGET_METRICS) + " FROM runs GROUP BY dataset, attack, budget"

QUERIES["operational_cost"] = lambda spark, sf: rounded(report.operational_cost(runs(spark, sf)), 6)
ORACLE["operational_cost"] = _RUNS + f" SELECT dataset, {_stats_sql(['runtime_seconds'], ('mean', 'std'))} FROM runs GROUP BY dataset"

_WORST_ROWS = """, ordered AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY attack_recall, attack, budget) AS rn FROM runs),
 worst_rows AS (SELECT * EXCLUDE (rn), clean_to_adv_attack_recall_drop AS robustness_gap FROM ordered WHERE rn = 1)"""
QUERIES["worst_case_table"] = lambda spark, sf: rounded(report.worst_case_table(runs(spark, sf)))
ORACLE["worst_case_table"] = _RUNS + _WORST_ROWS + " SELECT * REPLACE (" + ", ".join(f'round("{c}", 6) AS "{c}"' for c in [*_RUN_NUMERIC[6:24], *_RUN_NUMERIC[25:], "robustness_gap"]) + ") FROM worst_rows"


def _gate_table(spark, sf):
    table_ = runs(spark, sf)
    judged = G.decisions(worst(spark, sf, table_), POLICY, confounded=["F"])
    return rounded(report.gate_table(judged, report.worst_case_table(table_))).select("dataset", "seed", "decision", "worst_adv_attack_recall", "robustness_gap")


QUERIES["gate_table"] = _gate_table
ORACLE["gate_table"] = _DECIDED + _WORST_ROWS + " SELECT dataset, seed, decision, round(worst_adv_attack_recall, 6) AS worst_adv_attack_recall, round(robustness_gap, 6) AS robustness_gap FROM decided JOIN (SELECT dataset, seed, robustness_gap FROM worst_rows) USING (dataset, seed)"

QUERIES["master_results"] = lambda spark, sf: rounded(report.master_results(clean_runs(spark, sf), decided(spark, sf))).select("dataset", "seed", "f1", "attack_recall", "decision")
ORACLE["master_results"] = _DECIDED.replace("WITH ", "WITH " + CLEAN_RUNS + ", ", 1).replace(
    ", flows AS (SELECT *, CASE WHEN lower(trim(l_returnflag)) IN ('n') THEN 0 ELSE 1 END AS y FROM lineitem)", "", 1
) + " SELECT dataset, seed, f1, attack_recall, decision FROM clean_runs JOIN (SELECT dataset, seed, decision FROM decided) USING (dataset, seed)"


def expected(spark):
    """The grid asks for one seed more than was run."""
    return report.run_grid(spark, ["F", "O"], [0, 1, 2, 3], list(R.ATTACKS), list(R.BUDGETS))


_EXPECTED = """, expected AS (SELECT d.v AS dataset, s.v::INTEGER AS seed, a.v AS attack, b.v::DOUBLE AS budget FROM (VALUES ('F'), ('O')) d(v), (VALUES (0), (1), (2), (3)) s(v),
 (VALUES ('FGSM'), ('PGD')) a(v), (VALUES (0.01), (0.03), (0.05)) b(v)),
 manifest AS (SELECT e.*, CASE WHEN r.dataset IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, round(coalesce(r.runtime_seconds, 0.0)::DOUBLE, 6) AS runtime_seconds
  FROM expected e LEFT JOIN (SELECT dataset, seed, attack, budget, runtime_seconds FROM runs) r USING (dataset, seed, attack, budget))"""
QUERIES["run_manifest"] = lambda spark, sf: rounded(report.run_manifest(expected(spark), runs(spark, sf)))
ORACLE["run_manifest"] = _RUNS + _EXPECTED + " SELECT * FROM manifest"

QUERIES["run_completeness"] = lambda spark, sf: report.completeness(report.run_manifest(expected(spark), runs(spark, sf)))
ORACLE["run_completeness"] = _RUNS + _EXPECTED + """ SELECT count(*) AS expected_conditions, count(*) FILTER (WHERE status = 'COMPLETED') AS completed_conditions,
 count(*) FILTER (WHERE status <> 'COMPLETED') AS failed_conditions, count(DISTINCT (dataset, seed)) AS gate_decisions_expected FROM manifest"""

QUERIES["pending_conditions"] = lambda spark, sf: R.pending_conditions(expected(spark), runs(spark, sf), RUNS)
ORACLE["pending_conditions"] = _RUNS + _EXPECTED + " SELECT dataset, seed, attack, budget FROM manifest WHERE status = 'FAILED'"
