"""Composable steps over the channels of a table: feature extraction, column-scoped functions, Spark ML estimators.

A step is anything with fit(df) -> transformer and transform(df); a plain function of a DataFrame serves as one
without state. Spark ML gives the estimators; the adapter here packs named columns into a vector and unpacks the
result, so that a table keeps its column names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_features(df: DataFrame, key: Sequence[str], channels: Sequence[str], functions: dict[str, Callable[[Column], Column | list[Column]]]) -> DataFrame:
    """(key, feature, channels...): each aggregate of each channel in one aggregation, a row for each feature. A function that gives a list of aggregates makes a row for each, named feature_i."""
    packed = []
    for name, f in functions.items():
        made = [f(F.col(c)) for c in channels]
        parts = {f"{name}_{i}": m for i, m in enumerate(zip(*made))} if isinstance(made[0], list) else {name: made}
        packed += [F.struct(F.lit(n).alias("feature"), *(a.cast("double").alias(c) for a, c in zip(m, channels))) for n, m in parts.items()]
    return df.groupBy(*key).agg(F.array(*packed).alias("_f")).select(*key, F.inline("_f"))


def signal_features(df: DataFrame, channels: Sequence[str], functions: dict[str, Callable[..., Column]]) -> DataFrame:
    """Each function maps the channels of a row to a new channel."""
    return df.withColumns({name: f(*map(F.col, channels)) for name, f in functions.items()})


def channelwise(df: DataFrame, channels: Sequence[str], function: Callable[[Column], Column]) -> DataFrame:
    """The function put on each channel in place: shape-preserving ones, spectra (arrays of channels) and their inverses alike."""
    return df.withColumns({c: function(F.col(c)) for c in channels})


@dataclass(frozen=True)
class ColumnStep:
    """A function of some columns: in place, or under new names if there are any. Later steps see what earlier ones made."""

    columns: tuple[str, ...]
    function: Callable[[Column], Column]
    new: tuple[str, ...] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        missing = set(self.columns) - set(df.columns)
        if missing:
            raise KeyError(f"no such columns: {sorted(missing)}")
        if self.new is not None and len(self.new) != len(self.columns):
            raise ValueError("as many new names as columns are needed")
        return df.withColumns({n: self.function(F.col(c)) for c, n in zip(self.columns, self.new or self.columns)})


def to_vector(columns: Sequence[str]) -> Column:
    return array_to_vector(F.array(*(F.col(c).cast("double") for c in columns)))


def flattened(df: DataFrame, channels: Sequence[str], size: int, sep: str = ",") -> DataFrame:
    """Array channels of `size` samples as scalar columns named sample,channel."""
    kept = [c for c in df.columns if c not in channels]
    return df.select(*(F.col(f"`{c}`") for c in kept), *(F.get(c, F.lit(t)).alias(f"{t}{sep}{c}") for t in range(size) for c in channels))


def unflattened(df: DataFrame, channels: Sequence[str], size: int, sep: str = ",") -> DataFrame:
    """The inverse of `flattened`."""
    flat = {f"{t}{sep}{c}" for t in range(size) for c in channels}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in flat), *(F.array(*(F.col(f"`{t}{sep}{c}`") for t in range(size))).alias(c) for c in channels))


@dataclass
class MLStep:
    """A Spark ML estimator on named columns. Outputs as wide as the inputs replace them; others are named prefix_0, prefix_1, ... or, for a single number, prefix."""

    estimator: Estimator
    columns: Sequence[str]
    label: str | None = None
    prefix: str = "out"
    model: Model | None = field(default=None)

    def _packed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_in", to_vector(self.columns))

    def fit(self, df: DataFrame) -> MLStep:
        names = {"inputCol": "_in", "featuresCol": "_in", "outputCol": "_out", "predictionCol": "_out", "labelCol": self.label}
        given = {self.estimator.getParam(p): v for p, v in names.items() if v is not None and self.estimator.hasParam(p)}
        return MLStep(self.estimator, self.columns, self.label, self.prefix, self.estimator.fit(self._packed(df), given))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit this step before transforming with it")
        out = self.model.transform(self._packed(df))
        if out.schema["_out"].dataType.typeName() in ("double", "integer", "float"):
            return out.select(*(F.col(f"`{c}`") for c in df.columns), F.col("_out").alias(self.prefix))
        values = vector_to_array("_out")
        # the width is a constant of the fitted model
        width = out.select(F.size(values)).first()
        names = list(self.columns) if width and width[0] == len(self.columns) else [f"{self.prefix}_{i}" for i in range(width[0] if width else 0)]
        kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
        return out.withColumn("_out", values).select(*kept, *(F.get("_out", F.lit(i)).alias(n) for i, n in enumerate(names)))


@dataclass
class Chain:
    """Steps one after another; fit() fits each on what the earlier ones give."""

    steps: Sequence[object]

    def fit(self, df: DataFrame) -> Chain:
        done = []
        for s in self.steps:
            s = s.fit(df) if hasattr(s, "fit") else s
            done.append(s)
            df = _apply(df, s)
        return Chain(done)

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(_apply, self.steps, df)


def _apply(df: DataFrame, step: object) -> DataFrame:
    return step.transform(df) if hasattr(step, "transform") else step(df)


def save(chain: Chain, path: str) -> None:
    """The fitted Spark ML models of a chain, in order, to any path that Spark writes."""
    models = [s.model for s in chain.steps if isinstance(s, MLStep)]
    if not models or None in models:
        raise TypeError("only fitted Spark ML steps can be saved")
    PipelineModel(models).write().overwrite().save(path)


def load(chain: Chain, path: str) -> Chain:
    """The chain with its models read from `path`."""
    models = iter(PipelineModel.load(path).stages)
    return Chain([MLStep(s.estimator, s.columns, s.label, s.prefix, next(models)) if isinstance(s, MLStep) else s for s in chain.steps])


def _axes(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Means, variances along the principal axes in falling order, and the axes."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((n, n))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    size, axes = np.linalg.eigh(cov)
    return [float(row[f"m{i}"] or 0.0) for i in range(n)], size[::-1], axes[:, ::-1]


def explained_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, share): the share of the variance along each principal axis."""
    _, size, _ = _axes(df, columns)
    shares = np.maximum(size, 0) / max(size.sum(), 1e-300)
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(shares)], "component int, share double")


def principal_components(df: DataFrame, columns: Sequence[str], share: float | int = 0.75, prefix: str = "pc") -> DataFrame:
    """Scores on the leading axes of the centred columns: as many as explain `share` of the variance, or a given number. One aggregation yields means and covariances (columns squared, whatever the rows); the projection is plain arithmetic. An axis has its largest weight positive."""
    means, size, axes = _axes(df, columns)
    n = len(columns)
    k = int(share) if share >= 1 else int(np.searchsorted(np.cumsum(size) / max(size.sum(), 1e-300), share) + 1)
    k = min(k, n)
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(n)])
    project = lambda a: reduce(lambda x, y: x + y, ((F.col(c) - F.lit(means[i])) * float(axes[i, a] * signs[a]) for i, c in enumerate(columns)))
    return df.withColumns({f"{prefix}_{a}": project(a) for a in range(k)})
