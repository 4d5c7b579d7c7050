"""Bounded, rule-checked perturbations of scored rows and their effect.

Everything is a column expression, so all conditions of a grid are perturbed, scored and judged in one
pass. Scorers with a constant gradient sign (linear ones) are handled here; ``model.py`` adds the neural one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.functions.columns import join_by, named
from flowgate.functions.keys import ORDER_DIGITS, UNIFORM_DIGITS, order_key, uniform
from flowgate.functions.numbers import measured, share
from flowgate.operators.metrics import THRESHOLD, counts, predicted, ranking_areas, rates
from flowgate.operators.preprocess import Numeric

# Conditions of the grid and shape of the iterated attack.
ATTACKS = ("FGSM", "PGD")
BUDGETS = (0.01, 0.03, 0.05)
PGD_STEPS = 20
PGD_STEP_FRACTION = 0.25
ATTACK_SEED = 314159

# Texts of the attack map.
IMMUTABLE = ("IMMUTABLE", "preserve_exactly", "not independently attackable under conservative projected model")
STATUSES = ("MUTABLE_CONTINUOUS", "MUTABLE_DISCRETE", "CONDITIONALLY_MUTABLE_PROJECTABLE")


@dataclass(frozen=True)
class Attackable:
    """A feature that may be perturbed: why, how it is projected back, and whether it takes integers only."""

    feature: str
    status: str
    rule: str
    reason: str
    discrete: bool = False


@dataclass(frozen=True)
class Range:
    """A feature's training range in raw units, with the scaling that a model sees."""

    numeric: Numeric
    low: float
    high: float
    discrete: bool = False

    def epsilon(self, budget: Column) -> Column:
        """Budget as a share of the training range, in scaled units."""
        return budget * F.lit((self.high - self.low) / self.numeric.scale)

    @property
    def lower(self) -> float:
        return (self.low - self.numeric.mean) / self.numeric.scale

    @property
    def upper(self) -> float:
        return (self.high - self.numeric.mean) / self.numeric.scale


@dataclass(frozen=True)
class LinearScorer:
    """P(attack) = sigmoid(bias + weights · scaled features)."""

    weights: Mapping[str, float]
    bias: float = 0.0

    def score(self, values: Mapping[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for f, w in self.weights.items():
            total = total + F.lit(float(w)) * values[f]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def gradient_sign(self, feature: str) -> float:
        """Sign of the benign-class loss gradient: the loss grows with the score."""
        w = self.weights.get(feature, 0.0)
        return float((w > 0) - (w < 0))


# ---------------------------------------------------------------- contract and budget

def attack_map(train: DataFrame, features: Sequence[str], numeric: Sequence[str], attackable: Sequence[Attackable]) -> DataFrame:
    """One row per feature: may it be perturbed, how is it projected, and its numeric training range.

    Text is read as a number before minimum and maximum are taken.
    """
    known, wanted = {a.feature: a for a in attackable}, set(numeric)
    ranges = [c for i, f in enumerate(features) if f in wanted
              for c in (F.min(measured(named(f))).alias(f"lo{i}"), F.max(measured(named(f))).alias(f"hi{i}"))]
    rows = []
    for i, f in enumerate(features):
        a = known.get(f)
        status, rule, reason = (a.status, a.rule, a.reason) if a else IMMUTABLE
        discrete = bool(a and a.discrete)
        rows.append(
            F.struct(
                F.lit(f).alias("raw_feature"), F.lit("numeric" if f in wanted else "categorical").alias("semantic_type"),
                F.lit("PREDICTOR").alias("predictive_status"), F.lit(status).alias("adversarial_status"),
                F.lit(discrete).alias("discrete"), F.lit(rule).alias("projection_rule"),
                (F.col(f"lo{i}") + 0.0 if f in wanted else F.lit(None)).cast("double").alias("lower_bound"),
                (F.col(f"hi{i}") + 0.0 if f in wanted else F.lit(None)).cast("double").alias("upper_bound"),
                F.lit(1 if discrete else None).cast("int").alias("step"), F.lit("none").alias("dependency_group"),
                F.lit(reason).alias("justification"),
            )
        )
    return train.agg(*(ranges or [F.count(F.lit(1))])).select(F.inline(F.array(*rows)))


def attack_map_counts(mapped: DataFrame) -> DataFrame:
    """How many features each status has."""
    status = F.col("adversarial_status")
    found = [F.count_if(status == s).alias(s.lower()) for s in STATUSES]
    out = mapped.agg(F.count(F.lit(1)).alias("total_predictive_features"), *found)
    total = sum((F.col(s.lower()) for s in STATUSES), F.lit(0))
    return out.withColumns({"attackable_total": total, "immutable": F.col("total_predictive_features") - total})


def fit_ranges(train: DataFrame, numeric: Sequence[Numeric], discrete: Sequence[str] = ()) -> dict[str, Range]:
    """Training minimum and maximum of the attackable features: one row of parameters."""
    one = train.agg(
        *[F.min(measured(named(n.name))).alias(f"lo{i}") for i, n in enumerate(numeric)],
        *[F.max(measured(named(n.name))).alias(f"hi{i}") for i, n in enumerate(numeric)],
    ).first()
    return {n.name: Range(n, one[f"lo{i}"], one[f"hi{i}"], n.name in set(discrete)) for i, n in enumerate(numeric)}


def attack_budgets(spark: SparkSession, ranges: Mapping[str, Range], budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """Per attackable feature and budget: the step allowed and the bounds, in scaled units."""
    rows = [
        (f, float(b), b * (r.high - r.low) / r.numeric.scale, r.lower, r.upper) for f, r in ranges.items() for b in budgets
    ]
    return spark.createDataFrame(rows, "feature string, budget double, epsilon double, lower double, upper double")


# ---------------------------------------------------------------- perturbation

def project(z: Column, origin: Column, epsilon: Column, bounds: Range) -> Column:
    """Back into the budget around the original, then into the training range, then to whole raw units."""
    out = F.greatest(F.least(z, origin + epsilon), origin - epsilon)
    out = F.greatest(F.least(out, F.lit(bounds.upper)), F.lit(bounds.lower))
    if bounds.discrete:
        m, s = F.lit(bounds.numeric.mean), F.lit(bounds.numeric.scale)
        out = (F.rint(out * s + m) - m) / s
    return out


def fgsm(origin: Column, epsilon: Column, sign: float, bounds: Range) -> Column:
    """One full step against the gradient sign, projected."""
    return project(origin - epsilon * F.lit(sign), origin, epsilon, bounds)


def pgd(origin: Column, epsilon: Column, sign: float, bounds: Range, start: Column, steps: int = PGD_STEPS, fraction: float = PGD_STEP_FRACTION) -> Column:
    """Small steps from a random start inside the budget (``start`` in [0, 1)), projected after each.

    The direction never changes, so the way can be cut short. A continuous feature walks until it meets the
    edge of its interval: after the first projected step, one projected leap over the remaining ones ends at the
    same value. An integer feature moves by whole units: after two steps (the second settles ties to even) every
    further one covers the rounded step length, which may be none.
    """
    step = epsilon * F.lit(fraction * sign)
    z = project(origin + (start * 2 - 1) * epsilon - step, origin, epsilon, bounds)
    taken = 1
    if bounds.discrete and steps > 1:
        z = project(z - step, origin, epsilon, bounds)
        step, taken = F.rint(step * F.lit(bounds.numeric.scale)) / F.lit(bounds.numeric.scale), 2
    return project(z - step * (steps - taken), origin, epsilon, bounds) if steps > taken else z


def random_starts(key: Sequence[str], seed: object, names: Sequence[str]) -> list[Column]:
    """One number in [0, 1) per name from the row key; a hash serves several names with different digits."""
    per_hash = ORDER_DIGITS // UNIFORM_DIGITS
    return [uniform(order_key(key, f"{seed}/{i // per_hash}"), i % per_hash).alias(n) for i, n in enumerate(names)]


def attack_grid(
    df: DataFrame, y: str, scorer: LinearScorer, numeric: Sequence[Numeric], ranges: Mapping[str, Range], key: Sequence[str],
    attacks: Sequence[str] = ATTACKS, budgets: Sequence[float] = BUDGETS, seed: object = ATTACK_SEED, keep: Sequence[str] = (),
    steps: int = PGD_STEPS, fraction: float = PGD_STEP_FRACTION, threshold: float = THRESHOLD,
) -> DataFrame:
    """Every row under every condition: clean and adversarial score, and the size of the change.

    The conditions are an inline array that each row is exploded against. Benign rows stay as they are. The random
    start hashes row key, feature and seed, so the grid is the same on every run and partitioning.
    """
    conditions = F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(float(b)).alias("budget")) for a in attacks for b in budgets])
    base = df.select(
        *[named(k) for k in keep], named(y).alias("y"), *[n.scaled().alias(f"_z_{n.name}") for n in numeric],
        *(random_starts(key, seed, [f"_u_{f}" for f in ranges]) if "PGD" in attacks else [F.lit(0.5).alias(f"_u_{f}") for f in ranges]),
    )
    rows = base.select("*", F.explode(conditions).alias("_c")).select("*", "_c.attack", "_c.budget").drop("_c")
    moved = {}
    for f, r in ranges.items():
        z, e, sign = named(f"_z_{f}"), r.epsilon(F.col("budget")), scorer.gradient_sign(f)
        iterated = pgd(z, e, sign, r, named(f"_u_{f}"), steps, fraction)
        new = F.when(F.col("attack") == "FGSM", fgsm(z, e, sign, r)).otherwise(iterated)
        moved[f] = F.when(F.col("y") == 1, new).otherwise(z)
    rows = rows.withColumns({f"_a_{f}": c for f, c in moved.items()})
    clean = {n.name: named(f"_z_{n.name}") for n in numeric}
    attacked = {**clean, **{f: named(f"_a_{f}") for f in ranges}}
    change = [F.abs(named(f"_a_{f}") - named(f"_z_{f}")) for f in ranges]
    squares = sum((c * c for c in change[1:]), change[0] * change[0])
    outside = [
        (named(f"_a_{f}") > F.lit(r.upper + 1e-9)) | (named(f"_a_{f}") < F.lit(r.lower - 1e-9)) for f, r in ranges.items()
    ]
    broken = sum((o.cast("int") for o in outside[1:]), outside[0].cast("int"))
    scored = rows.select(
        *[named(k) for k in keep], "y", "attack", "budget",
        scorer.score(clean).alias("clean_score"), scorer.score(attacked).alias("score"),
        (F.greatest(*change) if len(change) > 1 else change[0]).alias("linf"), F.sqrt(squares).alias("l2"),
        sum(((c > 0).cast("int") for c in change[1:]), (change[0] > 0).cast("int")).alias("changed"),
        F.when(F.col("y") == 1, broken).otherwise(0).alias("violations"),
        *[named(f"_a_{f}").alias(f"adv_{f}") for f in ranges],
    )
    return scored.withColumns(
        {"clean_pred": predicted(F.col("clean_score"), threshold), "pred": predicted(F.col("score"), threshold)}
    )


# ---------------------------------------------------------------- effect

def attack_metrics(grid: DataFrame, by: Sequence[str], ranking: bool = True) -> DataFrame:
    """Per condition: all metrics under attack, success rate, drops against the clean scores, change size.

    Clean and adversarial counts come from the same aggregate, of which each map task hands on one row per condition. With ``ranking`` the scores alone are
    packed in a second pass, so no sums are kept for each of them. A grid that is dear to compute should be stored before.
    """
    y, cp, p = F.col("y"), F.col("clean_pred"), F.col("pred")
    clean = counts(y, cp)
    names = [named(b) for b in by]
    tallies = [
        F.count(F.lit(1)).alias("subset_N"), *counts(y, p), *[c.alias("clean_" + n) for c, n in zip(clean, ("tp", "tn", "fp", "fn"))],
        F.count_if((y == 1) & (cp == 1) & (p == 0)).alias("evaded"), F.count_if((y == 1) & (cp == 1)).alias("caught"),
        F.sum("linf").alias("_linf"), F.sum("l2").alias("_l2"), F.sum("changed").alias("_changed"), F.count_if(F.col("changed") == 0).alias("_still"),
        F.sum("violations").cast("bigint").alias("semantic_constraint_violations"),
    ]
    summed = grid.groupBy(*names).agg(*tallies)
    rows = F.col("subset_N")
    out = summed.withColumns({
        "mean_Linf": F.col("_linf") / rows, "mean_L2": F.col("_l2") / rows, "mean_changed_features": F.col("_changed") / rows,
        "projection_collapse_rate": share(F.col("_still"), rows),
    })
    attacked, before = rates(), rates("clean_")
    drops = {"attack_recall": "attack_recall", "f1": "F1", "mcc": "MCC", "accuracy": "accuracy"}
    out = out.select(
        *by, "subset_N", "tp", "tn", "fp", "fn", *[c.alias(n) for n, c in attacked.items()],
        share(F.col("evaded"), F.col("caught")).alias("attack_success_rate"),
        attacked["attack_recall"].alias("robust_attack_recall"),
        *[(before[m] - attacked[m]).alias(f"clean_to_adv_{label}_drop") for m, label in drops.items()],
        "mean_Linf", "mean_L2", "mean_changed_features", "projection_collapse_rate", "semantic_constraint_violations",
    )
    if not ranking:
        return out
    scores = grid.select(*names, "y", F.col("score").cast("double").alias("value"))
    return join_by(out, ranking_areas(scores, by, one_class=0.0), by, "left")


def enforce_constraints(
    df: DataFrame, original: Mapping[str, str], immutable: Sequence[str] = (), binary: Sequence[str] = (),
    discrete: Sequence[str] = (), lower: Mapping[str, float] | None = None, upper: Mapping[str, float] | None = None,
) -> DataFrame:
    """Repair candidate columns: clip, binary to 0/1, integers rounded half to even, immutables restored; in this order.

    ``original`` maps each candidate column to the column with its original value.
    """
    out = {}
    for c, source in original.items():
        x = named(c)
        if upper and c in upper:
            x = F.least(x, F.lit(float(upper[c])))
        if lower and c in lower:
            x = F.greatest(x, F.lit(float(lower[c])))
        if c in binary:
            x = F.greatest(F.least(F.rint(x), F.lit(1.0)), F.lit(0.0))
        if c in discrete:
            x = F.rint(x)
        if c in immutable:
            x = named(source).cast("double")
        out[c] = x
    return df.withColumns(out)


def constraint_violations(
    df: DataFrame, original: Mapping[str, str], immutable: Sequence[str] = (),
    lower: Mapping[str, float] | None = None, upper: Mapping[str, float] | None = None,
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Broken constraints per rule: immutables equal, bounds kept, and any further row rules that must be true."""
    checks = {f"immutable:{c}": ~named(c).eqNullSafe(named(original[c])) for c in immutable}
    checks |= {f"lower:{c}": named(c) < F.lit(float(v)) for c, v in (lower or {}).items()}
    checks |= {f"upper:{c}": named(c) > F.lit(float(v)) for c, v in (upper or {}).items()}
    checks |= {f"rule:{name}": ~rule for name, rule in (rules or {}).items()}
    one = df.agg(*[F.count_if(broken).alias(f"v{i}") for i, broken in enumerate(checks.values())])
    rows = [F.struct(F.lit(n).alias("constraint"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(checks)]
    return one.select(F.inline(F.array(*rows))).withColumn("holds", F.col("violations") == 0)


def pending_conditions(grid: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conditions without a finished run."""
    done = runs.select(*keys).distinct()
    return grid.join(done, list(keys), "left_anti")
