"""Audited table to model table: clean, resolve duplicates, sample, split without shared vectors, write, describe."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.functions.columns import forbidden_features, named
from flowgate.functions.keys import fingerprint
from flowgate.operators.duplicates import deduplicate
from flowgate.operators.sampling import RATIOS, SEED, pack_groups, split_label_groups, stratified_sample
from flowgate.operators.typeaudit import clean_rows
from flowgate.operators.verdicts import drop_conflicts
from flowgate.staging import stage

# Names of the two duplicate policies and of the model table's own columns.
DEDUPLICATE = "deduplicate_then_stratified"
DUPLICATE_AWARE = "duplicate_aware_stratified"
TARGET, FINGERPRINT = "binary_target", "fingerprint"


@dataclass(frozen=True)
class Contract:
    """What a model may see, and how its rows were chosen."""

    dataset: str
    numeric: tuple[str, ...]
    binary: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    target: str = "label"
    duplicate_policy: str = DEDUPLICATE
    exclude_conflicts: bool = True
    max_rows: int | None = None
    seed: int = SEED
    ratios: tuple[float, ...] = RATIOS
    text_numeric: tuple[str, ...] = field(default=())

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]

    def table(self, spark: SparkSession) -> DataFrame:
        """The contract as one row, with a digest of its content."""
        content = json.dumps(
            {
                "dataset": self.dataset, "features": self.features, "feature_count": len(self.features), "removed": list(self.removed), "target": self.target,
                "split_strategy": self.duplicate_policy, "seed": self.seed,
            },
            sort_keys=True,
        )
        out = spark.createDataFrame(
            [(self.dataset, self.features, len(self.features), list(self.removed), self.target, self.duplicate_policy, self.seed, content)],
            "dataset string, features array<string>, feature_count int, removed array<string>, target string, "
            "split_strategy string, seed int, content string",
        )
        return out.withColumn("config_id", F.sha2("content", 256)).drop("content")


def model_rows(df: DataFrame, contract: Contract, label: Column) -> DataFrame:
    """Features and 0/1 target of the rows that survive cleaning and the duplicate policy."""
    bad = forbidden_features(contract.features, [*contract.removed, TARGET, FINGERPRINT])
    if bad:
        raise ValueError(f"forbidden features in the contract: {bad}")
    rows = df.select(*[named(f) for f in contract.features], label.alias(TARGET))
    if contract.text_numeric:
        rows = clean_rows(rows, contract.text_numeric)
    if contract.duplicate_policy == DEDUPLICATE:
        return deduplicate(rows, contract.features, TARGET).drop("copies")
    return drop_conflicts(rows, contract.features, TARGET) if contract.exclude_conflicts else rows


def materialize(df: DataFrame, contract: Contract, label: Column) -> DataFrame:
    """The model table: features, target, fingerprint and split.

    The fingerprint covers the model's features, so no model input can occur in two splits. The rows left
    after cleaning and deduplication feed several passes and are staged once.
    """
    rows = stage(model_rows(df, contract, label))
    if contract.max_rows:
        if contract.duplicate_policy == DUPLICATE_AWARE:
            rows = stage(pack_groups(rows, TARGET, contract.features, contract.max_rows, contract.seed))
        else:
            rows = stage(stratified_sample(rows, TARGET, contract.max_rows, contract.seed, contract.features))
    out = split_label_groups(rows, TARGET, contract.features, contract.seed, contract.ratios)
    return out.withColumn(FINGERPRINT, fingerprint(contract.features))


def materialization_report(original_rows: int, model_table: DataFrame, contract: Contract) -> DataFrame:
    """Row counts before and after, strategy, and class counts per split."""
    splits = model_table.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(TARGET) == 0).alias("benign_rows"),
        F.count_if(F.col(TARGET) == 1).alias("attack_rows"),
    )
    return splits.select(
        F.lit(contract.dataset).alias("dataset"), F.lit(int(original_rows)).cast("bigint").alias("original_rows"),
        F.lit(len(contract.features)).alias("features"), F.lit(contract.seed).alias("seed"),
        F.lit(contract.duplicate_policy).alias("strategy"), "split", "rows", "benign_rows", "attack_rows",
    )
