"""Preprocessing that is fitted on the training rows only and applied everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgate.functions.columns import long_values, named
from flowgate.functions.numbers import finite
from flowgate.operators.quantiles import exact_quantiles
from flowgate.staging import stage

# A feature with more values becomes one sparse vector instead of one column per value.
MAX_VOCABULARY = 1000


@dataclass(frozen=True)
class Numeric:
    """Fitted state of a numeric feature: imputed value, mean and population deviation after imputing."""

    name: str
    median: float | None
    mean: float
    scale: float

    def imputed(self) -> Column:
        """Text and infinities become missing, missing becomes the training median."""
        return F.coalesce(finite(named(self.name)), F.lit(self.median).cast("double"))

    def scaled(self) -> Column:
        """A feature without any training value scales to 0."""
        return F.coalesce((self.imputed() - F.lit(self.mean)) / F.lit(self.scale), F.lit(0.0))

    def raw(self, z: Column) -> Column:
        return z * F.lit(self.scale) + F.lit(self.mean)


@dataclass(frozen=True)
class Category:
    """Fitted state of a categorical feature: imputed value and sorted vocabulary; ``sparse`` ones become one vector."""

    name: str
    mode: str | None
    vocabulary: tuple[str, ...]
    sparse: bool = False

    def imputed(self) -> Column:
        return F.coalesce(named(self.name).cast("string"), F.lit(self.mode).cast("string"))

    def indicators(self) -> dict[str, Column]:
        """One 0/1 column per known value; an unknown value is 0 in all of them."""
        return {f"categorical__{self.name}_{v}": self.imputed().eqNullSafe(F.lit(v)).cast("double") for v in self.vocabulary}


def _sparse(df: DataFrame, categories: Sequence[Category], columns: Sequence[str]) -> DataFrame:
    """The imputed texts of ``columns`` replaced by one-hot vectors, in vocabulary order; an unknown value is the zero vector."""
    if not categories:
        return df
    places, vectors = [f"{c}_place" for c in columns], [f"{c}_vector" for c in columns]
    # The place after the last known value stands for all unknown ones; dropping it leaves the zero vector.
    indexer = StringIndexerModel.from_arrays_of_labels([list(c.vocabulary) for c in categories], inputCols=list(columns), outputCols=places, handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=places, outputCols=vectors, dropLast=True)
    placed = indexer.transform(df)
    # The sizes are in the columns' metadata: no rows are read to fit.
    out = encoder.fit(placed.limit(0)).transform(placed)
    return out.select(*[F.col(v).alias(c) if (v := dict(zip(columns, vectors)).get(c)) else named(c) for c in df.columns])


@dataclass(frozen=True)
class Preprocessor:
    numeric: tuple[Numeric, ...]
    categorical: tuple[Category, ...]

    def _vectors(self) -> list[Category]:
        return [c for c in self.categorical if c.sparse]

    def outputs(self) -> dict[str, Column]:
        """Transformed columns with one number each in assembly order: the numeric block, then the categorical block."""
        out = {f"numeric__{n.name}": n.scaled() for n in self.numeric}
        for c in self.categorical:
            out.update({} if c.sparse else c.indicators())
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` and the transformed columns; a feature with a large vocabulary is one vector column at the end."""
        large = self._vectors()
        plain = [f"_c{i}" for i in range(len(large))]
        wide = df.select(*[named(k) for k in keep], *[c.alias(name) for name, c in self.outputs().items()], *[c.imputed().alias(p) for c, p in zip(large, plain)])
        return _sparse(wide, large, plain).withColumnsRenamed({p: f"categorical__{c.name}" for c, p in zip(large, plain)})

    def assemble(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
        """The transformed columns as one vector column, sparse where most of it is zero."""
        plain = [f"_x{i}" for i in range(len(self.outputs()))]
        large = self._vectors()
        texts = [f"_c{i}" for i in range(len(large))]
        columns = [c.alias(p) for p, c in zip(plain, self.outputs().values())]
        wide = _sparse(df.select(*[named(k) for k in keep], *columns, *[c.imputed().alias(p) for c, p in zip(large, texts)]), large, texts)
        return VectorAssembler(inputCols=plain + texts, outputCol=output).transform(wide).select(*[named(k) for k in keep], output)

    def lineage(self, spark: SparkSession) -> DataFrame:
        """Which transformed columns each raw feature became."""
        rows = [(n.name, "numeric impute+scale", [f"numeric__{n.name}"]) for n in self.numeric]
        rows += [(c.name, "categorical one-hot", [f"categorical__{c.name}"] if c.sparse else list(c.indicators())) for c in self.categorical]
        return spark.createDataFrame(rows, "raw_feature string, transformer string, output_features array<string>")

    def parameters(self, spark: SparkSession) -> DataFrame:
        """The fitted state as a table, to store and to compare."""
        rows = [(n.name, "numeric", n.median, n.mean, n.scale, None, None) for n in self.numeric]
        rows += [(c.name, "sparse" if c.sparse else "categorical", None, None, None, c.mode, list(c.vocabulary)) for c in self.categorical]
        return spark.createDataFrame(
            rows, "feature string, kind string, median double, mean double, scale double, mode string, vocabulary array<string>"
        )

    @staticmethod
    def load(parameters: DataFrame) -> "Preprocessor":
        """Rebuild from a stored parameter table (one row per feature)."""
        rows = parameters.collect()
        return Preprocessor(
            tuple(Numeric(r.feature, r.median, r["mean"], r.scale) for r in rows if r.kind == "numeric"),
            tuple(Category(r.feature, r["mode"], tuple(r.vocabulary), r.kind == "sparse") for r in rows if r.kind != "numeric"),
        )


def fit_numeric(train: DataFrame, features: Sequence[str]) -> tuple[Numeric, ...]:
    """Exact medians first, then mean and population deviation of the imputed values in one aggregate."""
    if not features:
        return ()
    medians = {r.feature: r["quantile"] for r in exact_quantiles(train, features, [0.5]).collect()}
    imputed = [F.coalesce(finite(named(f)), F.lit(medians.get(f)).cast("double")) for f in features]
    stats = train.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(imputed)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(imputed)]
    ).first()
    # A constant feature is only centred.
    return tuple(
        Numeric(f, medians.get(f), stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0) for i, f in enumerate(features)
    )


def fit_categories(train: DataFrame, features: Sequence[str], max_vocabulary: int = MAX_VOCABULARY) -> tuple[Category, ...]:
    """Most frequent value (ties to the smallest) and sorted vocabulary of each feature, from one grouping of all of them.

    Each feature is judged by its own number of values: more than ``max_vocabulary`` make it sparse. Vocabularies are parameters that the
    driver holds, whatever their size.
    """
    if not features:
        return ()
    present = long_values(train, features).where(F.col("value").isNotNull())
    counted = stage(present.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    facts = counted.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"), F.sort_array(F.collect_list("value")).alias("vocabulary"))
    found = {r.feature: (r.top.value, tuple(r.vocabulary)) for r in facts.collect()}
    return tuple(Category(f, *found.get(f, (None, ())), sparse=len(found.get(f, (None, ()))[1]) > max_vocabulary) for f in features)


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_vocabulary: int = MAX_VOCABULARY) -> Preprocessor:
    return Preprocessor(fit_numeric(train, numeric), fit_categories(train, categorical, max_vocabulary))


def index_categories(train: DataFrame, features: Sequence[str], modes: dict[str, str]) -> PipelineModel:
    """One-hot encoding of large vocabularies as sparse vectors; unknown values become the zero vector.

    Columns are expected to be imputed already: ``modes`` says with what, see ``impute_modes``.
    """
    plain = list(features)
    indexer = StringIndexer(
        inputCols=plain, outputCols=[f"{f}_index" for f in plain], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    # The index after the last known value stands for all unknown ones; dropping it leaves the zero vector.
    encoder = OneHotEncoder(inputCols=[f"{f}_index" for f in plain], outputCols=[f"{f}_vector" for f in plain], dropLast=True)
    return Pipeline(stages=[indexer, encoder]).fit(impute_modes(train, modes))


def impute_modes(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(named(f).cast("string"), F.lit(m)) for f, m in modes.items()})
