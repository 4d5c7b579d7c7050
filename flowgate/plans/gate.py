"""From run metrics to an explainable PASS or BLOCK.

Run tables hold one row per (dataset, seed, attack, budget): small, but handled as DataFrames so that the
decision can follow the runs in the same job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ("dataset", "seed")

# The default policy.
POLICY = {
    "policy_id": "default",
    "thresholds": {
        "clean_attack_recall_min": 0.95,
        "robust_attack_recall_min": 0.80,
        "attack_success_rate_max": 0.20,
        "attack_recall_drop_max": 0.20,
    },
    "integrity": {
        "require_zero_semantic_violations": True,
        "require_complete_adversarial_matrix": True,
        "require_zero_fingerprint_overlap": True,
        "block_confirmed_leakage": True,
    },
}
CONDITIONS = 6
SENSITIVITY_RECALL = (0.7, 0.8, 0.9)
SENSITIVITY_SUCCESS = (0.1, 0.2, 0.3)

# Reason codes in reporting order, and the texts of a decision.
REASONS = {
    "clean_performance": "BLOCK_LOW_CLEAN_RECALL",
    "robust_recall": "BLOCK_LOW_ROBUST_RECALL",
    "attack_success_rate": "BLOCK_HIGH_ATTACK_SUCCESS_RATE",
    "degradation": "BLOCK_EXCESSIVE_RECALL_DROP",
    "integrity": "BLOCK_ARTIFACT_INTEGRITY",
}
PASSED = "PASS_ALL_CRITERIA"
CONFOUNDING_WARNING = "WARNING_DATASET_CONFOUNDING"
CONFOUNDED_STATUS = "NO_DIRECT_LEAKAGE_WITH_DATASET_CONFOUNDING"
CLEAN_STATUS = "NO_EVIDENCE_OF_LEAKAGE"
CLEAN_ONLY_RECALL = 0.95


def policy_digest(policy: Mapping) -> str:
    return json.dumps(policy, sort_keys=True, separators=(",", ":"))


def worst_cases(runs: DataFrame) -> DataFrame:
    """Worst outcome over the conditions of each run; clean recall from the mildest single-step condition.

    A figure that is missing or NaN in one condition is missing in the outcome: it must not be skipped as if it were fine.
    """
    clean = F.col("attack_recall") + F.col("clean_to_adv_attack_recall_drop")
    return runs.groupBy(*RUN).agg(
        F.min_by(clean, F.struct("attack", "budget")).alias("clean_attack_recall"),
        _if_all_known("attack_recall", F.min).alias("worst_adv_attack_recall"),
        _if_all_known("attack_success_rate", F.max).alias("max_ASR"),
        _if_all_known("clean_to_adv_attack_recall_drop", F.max).alias("max_recall_drop"),
        _if_all_known("semantic_constraint_violations", F.sum).cast("bigint").alias("semantic_violations"),
        F.count(F.lit(1)).alias("conditions"),
    )


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _if_all_known(name: str, worst: Callable[[str], Column]) -> Column:
    return F.when(F.bool_and(_known(F.col(name))), worst(name))


def _at_least(c: Column, limit: Column | float) -> Column:
    return _known(c) & (c >= limit)


def _at_most(c: Column, limit: Column | float) -> Column:
    return _known(c) & (c <= limit)


def _criteria(worst: DataFrame, thresholds: Mapping[str, Column], integrity: Mapping[str, bool]) -> dict[str, Column]:
    complete = F.lit(True)
    if integrity.get("require_zero_semantic_violations"):
        complete = complete & (F.col("semantic_violations") == 0)
    if integrity.get("require_complete_adversarial_matrix"):
        complete = complete & (F.col("conditions") == CONDITIONS)
    # Evidence columns from the leakage audit, joined to the runs by the caller. A check that is asked for fails without.
    def evidence(name: str) -> Column:
        return F.col(name) if name in worst.columns else F.lit(None)

    if integrity.get("require_zero_fingerprint_overlap"):
        complete = complete & (evidence("fingerprint_overlap").cast("bigint") == 0)
    if integrity.get("block_confirmed_leakage"):
        complete = complete & ~evidence("confirmed_leakage").cast("boolean")
    return {
        "clean_performance": _at_least(F.col("clean_attack_recall"), thresholds["clean_attack_recall_min"]),
        "robust_recall": _at_least(F.col("worst_adv_attack_recall"), thresholds["robust_attack_recall_min"]),
        "attack_success_rate": _at_most(F.col("max_ASR"), thresholds["attack_success_rate_max"]),
        "degradation": _at_most(F.col("max_recall_drop"), thresholds["attack_recall_drop_max"]),
        "integrity": complete,
    }


def _codes(checks: Mapping[str, Column], names: Mapping[str, str]) -> Column:
    """Names of the checks that are not met, in order; a check that cannot be evaluated is not met."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(names[k])) for k, ok in checks.items()]))


def decisions(worst: DataFrame, policy: Mapping = POLICY, confounded: Sequence[str] = ()) -> DataFrame:
    """PASS or BLOCK per run with its reason codes, warnings and the digest of the policy it was judged by."""
    thresholds = {k: F.lit(float(v)) for k, v in policy["thresholds"].items()}
    codes = _codes(_criteria(worst, thresholds, policy["integrity"]), REASONS)
    suspect = F.col("dataset").isin(list(confounded)) if confounded else F.lit(False)
    judged = worst.withColumn("_codes", codes)
    return judged.select(
        *RUN,
        F.when(F.size("_codes") == 0, "PASS").otherwise("BLOCK").alias("decision"),
        "clean_attack_recall", "worst_adv_attack_recall", "max_ASR", "max_recall_drop", "semantic_violations",
        F.when(suspect, CONFOUNDED_STATUS).otherwise(CLEAN_STATUS).alias("leakage_status"),
        F.array_join("_codes", ";").alias("failed_criteria"),
        F.when(suspect, CONFOUNDING_WARNING).otherwise("").alias("warnings"),
        F.lit(policy["policy_id"]).alias("policy_id"),
        F.sha2(F.lit(policy_digest(policy)), 256).alias("policy_hash"),
        F.when(F.size("_codes") == 0, F.array(F.lit(PASSED))).otherwise(F.col("_codes")).alias("reason_codes"),
    )


def sensitivity(
    worst: DataFrame, policy: Mapping = POLICY,
    recalls: Sequence[float] = SENSITIVITY_RECALL, successes: Sequence[float] = SENSITIVITY_SUCCESS,
) -> DataFrame:
    """How many runs would pass under each pair of thresholds. The pairs are an inline array per run."""
    pairs = F.array(*[
        F.struct(F.lit(float(r)).alias("robust_attack_recall_min"), F.lit(float(a)).alias("attack_success_rate_max"))
        for r in recalls for a in successes
    ])
    grid = worst.withColumn("_t", F.explode(pairs)).select(*worst.columns, "_t.*")
    thresholds = {k: F.lit(float(v)) for k, v in policy["thresholds"].items()}
    thresholds |= {k: F.col(k) for k in ("robust_attack_recall_min", "attack_success_rate_max")}
    checks = _criteria(worst, thresholds, policy["integrity"])
    passed = F.size(_codes(checks, REASONS)) == 0
    return grid.groupBy("robust_attack_recall_min", "attack_success_rate_max").agg(
        F.lit("validation_only").alias("calibration_source"), F.count_if(passed).alias("models_passed")
    )


def stability(decided: DataFrame) -> DataFrame:
    """Per dataset: passed and blocked seeds, mean figures, and whether all seeds agree."""
    out = decided.groupBy("dataset").agg(
        F.count_if(F.col("decision") == "PASS").alias("PASS_seeds"),
        F.count_if(F.col("decision") == "BLOCK").alias("BLOCK_seeds"),
        F.avg("clean_attack_recall").alias("clean_recall_mean"),
        F.avg("worst_adv_attack_recall").alias("worst_adv_recall_mean"),
        F.avg("max_ASR").alias("ASR_mean"),
    )
    agreed = (
        F.when(F.col("BLOCK_seeds") == 0, "STABLE_PASS").when(F.col("PASS_seeds") == 0, "STABLE_BLOCK").otherwise("SEED_SENSITIVE")
    )
    return out.withColumn("decision_stability", agreed)


def basic_gate(models: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """The four-condition gate on clean F1, clean recall, adversarial recall and relative F1 drop.

    ``models`` has one row per model with ``clean_f1``, ``clean_attack_recall``,
    ``adversarial_attack_recall`` and ``relative_f1_drop``.
    """
    checks = {
        "clean_f1": _at_least(F.col("clean_f1"), float(thresholds["min_clean_f1"])),
        "clean_attack_recall": _at_least(F.col("clean_attack_recall"), float(thresholds["min_clean_attack_recall"])),
        "adversarial_attack_recall": _at_least(F.col("adversarial_attack_recall"), float(thresholds["min_adversarial_attack_recall"])),
        "relative_f1_drop": _at_most(F.col("relative_f1_drop"), float(thresholds["max_relative_f1_drop"])),
    }
    failed = _codes(checks, {k: k for k in checks})
    out = models.withColumn("failed_conditions", failed)
    return out.withColumn("decision", F.when(F.size("failed_conditions") == 0, "PASS").otherwise("BLOCK"))


def value_added(decided: DataFrame) -> DataFrame:
    """What a gate on clean recall alone would have said, and where the full gate differs."""
    clean_only = F.when(_at_least(F.col("clean_attack_recall"), CLEAN_ONLY_RECALL), "PASS").otherwise("BLOCK")
    return decided.withColumn("clean_only_decision", clean_only).withColumn(
        "decision_changed", F.col("clean_only_decision") != F.col("decision")
    )
