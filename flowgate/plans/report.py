"""Summary tables over runs, and the completeness of the run grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.functions.columns import join_by, named, numeric_columns
from flowgate.plans.gate import RUN

# Columns of the long summary and of the budget response.
SUMMARY_METRICS = (
    "attack_recall", "attack_success_rate", "f1", "mcc", "accuracy", "runtime_seconds",
    "clean_to_adv_attack_recall_drop", "clean_to_adv_F1_drop",
)
BUDGET_METRICS = ("attack_recall", "attack_success_rate", "clean_to_adv_attack_recall_drop", "runtime_seconds")
CONDITION = ("dataset", "attack", "budget")
KEYS = ("dataset", "seed", "attack", "budget")

_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def summarize(runs: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Statistics of numeric columns per group, flattened to ``column_statistic``."""
    columns = list(columns) if columns else numeric_columns(runs, by)
    return runs.groupBy(*[named(b) for b in by]).agg(*[_STATS[s](named(c)).alias(f"{c}_{s}") for c in columns for s in stats])


def clean_table(runs: DataFrame) -> DataFrame:
    """Mean and deviation of every numeric column of the clean runs, per dataset."""
    return summarize(runs, ["dataset"])


def adversarial_table(runs: DataFrame) -> DataFrame:
    """Mean and deviation of every numeric column, per dataset, attack and budget."""
    return summarize(runs, CONDITION, numeric_columns(runs, CONDITION))


def adversarial_summary(runs: DataFrame) -> DataFrame:
    """Mean, deviation, minimum and maximum of the reported metrics, per dataset, attack and budget."""
    return summarize(runs, CONDITION, [c for c in SUMMARY_METRICS if c in runs.columns], ("mean", "std", "min", "max"))


def budget_response(runs: DataFrame) -> DataFrame:
    """Mean effect per dataset, attack and budget."""
    present = [c for c in BUDGET_METRICS if c in runs.columns]
    return runs.groupBy(*CONDITION).agg(*[F.avg(c).alias(c) for c in present])


def operational_cost(runs: DataFrame, column: str = "runtime_seconds") -> DataFrame:
    """Mean and deviation of the run time per dataset."""
    return summarize(runs, ["dataset"], [column])


def worst_case_table(runs: DataFrame) -> DataFrame:
    """The whole row of the condition with the lowest recall per run (ties by attack and budget), and the recall
    it lost against clean data."""
    rows = F.struct(*[named(c).alias(c) for c in runs.columns])
    worst = runs.groupBy(*RUN).agg(F.min_by(rows, F.struct("attack_recall", "attack", "budget")).alias("w"))
    return worst.select("w.*").withColumn("robustness_gap", F.col("clean_to_adv_attack_recall_drop"))


def gate_table(decided: DataFrame, worst: DataFrame) -> DataFrame:
    """Decisions with the robustness gap of their run, in the order of data set and seed."""
    return join_by(decided, worst.select(*RUN, "robustness_gap"), list(RUN)).orderBy(*RUN)


def master_results(clean_runs: DataFrame, decided: DataFrame) -> DataFrame:
    """Clean runs with their decision, in the order of data set and seed."""
    return join_by(clean_runs, decided.select(*RUN, "decision"), list(RUN)).orderBy(*RUN)


def run_grid(spark: SparkSession, datasets: Sequence[str], seeds: Sequence[int], attacks: Sequence[str], budgets: Sequence[float]) -> DataFrame:
    """All expected conditions, unfolded from four inline lists."""
    out = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))
    for name, values in (("seed", seeds), ("attack", attacks), ("budget", budgets)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def run_manifest(grid: DataFrame, runs: DataFrame) -> DataFrame:
    """Every expected condition with its status; a condition without a result has failed."""
    done = runs.select(*KEYS, F.lit("COMPLETED").alias("_status"), *[c for c in ("runtime_seconds",) if c in runs.columns])
    out = join_by(grid, done, list(KEYS), "left")
    cost = F.coalesce(F.col("runtime_seconds"), F.lit(0.0)) if "runtime_seconds" in done.columns else F.lit(0.0)
    return out.select(*KEYS, F.coalesce("_status", F.lit("FAILED")).alias("status"), cost.alias("runtime_seconds"))


def completeness(manifest: DataFrame) -> DataFrame:
    """Expected, completed and failed conditions, and the number of gate decisions to expect."""
    done = F.col("status") == "COMPLETED"
    return manifest.agg(
        F.count(F.lit(1)).alias("expected_conditions"),
        F.count_if(done).alias("completed_conditions"),
        F.count_if(~done).alias("failed_conditions"),
        F.countDistinct(*RUN).alias("gate_decisions_expected"),
    )
