"""Raw table to labelled, sampled and split table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.functions.columns import named
from flowgate.functions.labels import binary_label
from flowgate.operators.sampling import RATIOS, SEED, split_rows, stratified_sample
from flowgate.sources.tables import write_splits
from flowgate.staging import stage

TARGET = "binary_target"


def prepare(
    df: DataFrame, target: str, benign: Iterable[object], max_rows: int | None, seed: object = SEED,
    ratios: Sequence[float] = RATIOS, key: Sequence[str] | None = None, path: str | None = None,
) -> DataFrame:
    """Label, draw a stratified sample, split by row; written by split when a path is given.

    The sample feeds several passes of the split and is staged once.
    """
    labelled = df.withColumn(TARGET, binary_label(named(target), benign))
    sample = stage(stratified_sample(labelled, TARGET, max_rows, seed, key))
    out = split_rows(sample, TARGET, seed, ratios, key)
    return write_splits(out, path) if path else out


def preparation_report(population: DataFrame, prepared: DataFrame) -> DataFrame:
    """Population size, sample size and class counts per split."""
    return prepared.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(TARGET) == 0).alias("benign_rows"),
        F.count_if(F.col(TARGET) == 1).alias("attack_rows"),
    ).withColumn("population_rows", F.lit(population.count()))
