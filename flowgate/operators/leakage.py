"""Leakage and proxy audits of features and splits, and feature roles from a policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgate.functions.columns import forbidden_features, long_values
from flowgate.functions.numbers import finite, share
from flowgate.operators.metrics import ranking_areas
from flowgate.operators.sampling import split_overlap
from flowgate.staging import stage

# Fixed values: (semantic type, status, constraints, reason) of each policy role.
ROLES = {
    "remove": ("REMOVED", "REMOVE", "none", "frozen exclusion from model X"),
    "binary": ("BINARY", "IMMUTABLE", "observed binary domain", "frozen binary model feature"),
    "categorical": ("CATEGORICAL", "IMMUTABLE", "train vocabulary only", "frozen categorical model feature"),
    "mutable": (
        "CONTINUOUS_PRIMITIVE", "MUTABLE", "projection, observed train range and integer rule where applicable",
        "frozen independently mutable model feature",
    ),
    "conditional": (
        "CONDITIONALLY_MUTABLE", "CONDITIONALLY_MUTABLE", "joint feasibility projection required",
        "frozen conditional attack candidate",
    ),
    "numeric": ("NUMERIC", "IMMUTABLE", "not in independent attack mask", "frozen numeric model feature"),
    "other": ("REMOVED", "REMOVE", "none", "not selected in the frozen model feature set"),
}

# Decision and risk by status; statuses not listed are kept at low risk.
DECISIONS = {"REMOVE": ("REMOVE", "HIGH"), "CONDITIONALLY_MUTABLE": ("REVIEW", "MEDIUM")}
DEFAULT_DECISION = ("KEEP", "LOW")

# Name parts that hint at derived and at discrete quantities, and the discrete cardinality limit.
DERIVED_TOKENS = ("mean", "std", "rate", "variance", "bytes")
DISCRETE_TOKENS = ("port", "count", "pkts", "len", "ttl", "number", "seq", "trans_id")
DISCRETE_LIMIT = 256

# Text of the heuristic classes.
CLASSES = {
    "target": ("CATEGORICAL", "REMOVE", "none", "target/label metadata or provenance; direct leakage"),
    "provenance": ("IDENTIFIER", "REMOVE", "none", "target/label metadata or provenance; direct leakage"),
    "timestamp": ("TEMPORAL", "REMOVE", "none", "high-cardinality identity/content field; memorization and privacy risk"),
    "identifier": ("IDENTIFIER", "REMOVE", "none", "high-cardinality identity/content field; memorization and privacy risk"),
    "derived": (
        "CONTINUOUS_DERIVED", "CONDITIONALLY_MUTABLE", "nonnegative; preserve algebraic dependencies",
        "aggregate derived from packet/flow primitives",
    ),
    "binary": (
        "BINARY", "IMMUTABLE", "values from observed binary domain", "continuous perturbation would create invalid flag values",
    ),
    "categorical": (
        "CATEGORICAL", "IMMUTABLE", "values from training vocabulary", "category cannot receive arbitrary continuous perturbations",
    ),
    "temporal": (
        "TEMPORAL", "CONDITIONALLY_MUTABLE", "nonnegative; jointly consistent with rates/counters",
        "timing can change but only under traffic constraints",
    ),
    "discrete": (
        "DISCRETE", "CONDITIONALLY_MUTABLE", "integer; observed range; nonnegative", "protocol/count field with bounded feasible values",
    ),
    "continuous": (
        "CONTINUOUS_PRIMITIVE", "MUTABLE", "observed train range; nonnegative where applicable",
        "continuous traffic measurement, subject to feasibility projection",
    ),
}
CLASS_FIELDS = ("semantic_type", "adversarial_status", "constraints", "reason")

# Proxy report.
PROXY_RISK = "SCENARIO_ASSOCIATED_BUT_LEGITIMATE"
PROXY_REASON = "Observed traffic/protocol attribute; no target or provenance lineage."


def value_cells(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, value, n0, n1): rows of either class with a value, in one table combined map-side instead of one crosstab per feature."""
    return long_values(df, features, keep=[label]).groupBy("feature", "value").agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )


def value_purity(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature: distinct values, values seen in one class only, and the purest value's class share."""
    return _purity(value_cells(df, features, label))


def _purity(cells: DataFrame) -> DataFrame:
    n = F.col("n0") + F.col("n1")
    seen = F.col("value").isNotNull()
    readable = finite(F.col("value"))
    return cells.groupBy("feature").agg(
        F.count("value").alias("unique_values"),
        F.count_if(seen & (F.least("n0", "n1") == 0)).alias("exclusive_values"),
        F.max(F.when(seen, share(F.greatest("n0", "n1"), n))).alias("max_class_purity"),
        F.coalesce(F.sum(F.when(readable.isNull(), n)), F.lit(0)).alias("unreadable_rows"),
    )


def univariate_leakage(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Purity, single-feature ROC AUC and proxy flag of each raw feature.

    The AUC is missing when any value of the feature is missing, infinite or not a number.
    """
    cells = stage(value_cells(df, features, label))
    purity = _purity(cells)
    # texts that are the same number are one score
    scores = cells.select("feature", finite(F.col("value")).alias("value"), "n0", "n1").where("value is not null")
    areas = ranking_areas(scores.groupBy("feature", "value").agg(F.sum("n1").alias("pos"), F.sum("n0").alias("neg")), ["feature"]).select("feature", "roc_auc")
    proxy = (F.col("max_class_purity") == 1) & (F.col("exclusive_values") > 1)
    # One row per feature on both sides.
    return purity.join(areas, "feature", "left").select(
        "feature", "unique_values", "exclusive_values", "max_class_purity",
        F.when(F.col("unreadable_rows") == 0, F.col("roc_auc")).alias("univariate_auc"),
        F.when(proxy, "POTENTIAL_PROXY").otherwise("NORMAL").alias("status"),
    )


def proxy_report(leakage: DataFrame, categorical: Sequence[str], top: int = 5) -> DataFrame:
    """The leakage table with its reviewed decision columns; ``predictive_rank`` is set for the features
    whose AUC is farthest from one half."""
    far = F.abs(F.col("univariate_auc") - 0.5)
    ranked = leakage.where(far.isNotNull()).orderBy(far.desc(), "feature").limit(top)
    places = ranked.agg(F.sort_array(F.collect_list(F.struct(far.alias("d"), F.col("feature").alias("f"))), asc=False).alias("l"))
    order = places.select(F.posexplode("l").alias("predictive_rank", "x")).select(
        F.col("x.f").alias("feature"), (F.col("predictive_rank") + 1).alias("predictive_rank")
    )
    return leakage.join(order, "feature", "left").select(
        "*",
        F.when(F.col("feature").isin(list(categorical)), "CATEGORICAL").otherwise("NETWORK_MEASUREMENT").alias("semantic_type"),
        F.lit(True).alias("inference_available"),
        F.lit(PROXY_RISK).alias("proxy_risk"), F.lit("KEEP").alias("decision"), F.lit(PROXY_REASON).alias("reason"),
    )


def split_audit(df: DataFrame, features: Sequence[str], identity: Sequence[str], forbidden: Sequence[str], split: str = "split") -> DataFrame:
    """Contract size, forbidden features, vectors shared between splits, and PASS or FAIL."""
    listed = forbidden_features(features, forbidden)
    pairs = split_overlap(df, identity, split)
    pair = lambda a, b: F.sum(
        F.when((F.col("left_split") == a) & (F.col("right_split") == b), F.col("shared_vectors"))
    )
    out = pairs.agg(
        pair("train", "validation").alias("overlap_train_validation"),
        pair("train", "test").alias("overlap_train_test"),
        pair("validation", "test").alias("overlap_validation_test"),
        F.sum("shared_vectors").alias("_any"),
    )
    failed = (F.col("_any") > 0) | F.lit(bool(listed))
    return out.select(
        F.lit(len(set(features))).alias("feature_contract_count"),
        F.array(*[F.lit(f) for f in listed]).cast("array<string>").alias("forbidden_features"),
        "overlap_train_validation", "overlap_train_test", "overlap_validation_test",
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
    )


def _described(key: Column, table: Mapping[str, Sequence[str]]) -> list[Column]:
    """The text columns that belong to a role or class name."""
    entries = F.create_map(*[x for k, row in table.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in row]))])
    return [entries[key][i].alias(f) for i, f in enumerate(CLASS_FIELDS)]


def feature_roles(stats: DataFrame, policy: Mapping[str, Sequence[str]]) -> DataFrame:
    """Role of each feature from a policy of name lists; the first list in ``ROLES`` order wins.

    ``stats`` is a column profile: ``feature`` and any statistics to carry along.
    """
    role = F.lit("other")
    for name in reversed([r for r in ROLES if r != "other"]):
        role = F.when(F.col("feature").isin(list(policy.get(name, ()))), name).otherwise(role)
    return stats.withColumn("_role", role).select("*", *_described(F.col("_role"), ROLES)).drop("_role")


def leakage_decisions(roles: DataFrame) -> DataFrame:
    """REMOVE at high risk, REVIEW at medium risk, otherwise KEEP."""
    status = F.col("adversarial_status")
    decision, risk = F.lit(DEFAULT_DECISION[0]), F.lit(DEFAULT_DECISION[1])
    for key, (d, r) in DECISIONS.items():
        decision, risk = F.when(status == key, d).otherwise(decision), F.when(status == key, r).otherwise(risk)
    return roles.withColumns({"decision": decision, "risk": risk})


def semantic_classes(stats: DataFrame, names: Mapping[str, Sequence[str]], cardinality: str = "cardinality", text_table: bool = False) -> DataFrame:
    """Heuristic class of each column from its name, type and cardinality.

    ``names`` lists known names by kind: target, provenance, timestamp, identifier, derived, binary,
    categorical, temporal. ``stats`` has ``feature``, ``dtype`` and a cardinality. ``text_table`` is for tables that are read as text: there a column
    without an ``analysis_dtype``, one that is not read as numbers, is categorical whatever its type.
    """
    feature, n = F.col("feature"), F.col(cardinality)
    low = F.lower(feature)

    def listed(kind: str) -> Column:
        return feature.isin(list(names.get(kind, ())))

    def has(tokens: Sequence[str]) -> Column:
        return low.rlike("|".join(tokens))

    kind = (
        F.when(listed("provenance"), "provenance")
        .when(listed("target"), "target")
        .when(listed("timestamp"), "timestamp")
        .when(listed("identifier"), "identifier")
        .when(listed("derived") | has(DERIVED_TOKENS), "derived")
        .when(listed("binary") | ((n == 2) & ~listed("categorical")), "binary")
        .when(listed("categorical") | (F.col("dtype") == "string") | (F.col("analysis_dtype").isNull() if text_table else F.lit(False)), "categorical")
        .when(listed("temporal"), "temporal")
        .when((n <= DISCRETE_LIMIT) | has(DISCRETE_TOKENS), "discrete")
        .otherwise("continuous")
    )
    return stats.withColumn("_class", kind).select("*", *_described(F.col("_class"), CLASSES)).drop("_class")
