"""Augmentation of series: seeded, so that a rerun or a retried task gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import series
from .signal import on_arrays


def uniform(*of: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the given columns and the seed alone: 52 bits of the MD5 of their text, so other engines can draw it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in of), F.lit(str(seed)))), 1, 13), 16, 10).cast("long") / float(1 << 52)


def _drawn(func: Callable[[np.ndarray, np.ndarray], np.ndarray], x: Column, draws: list[Column]) -> Column:
    """A kernel of a signal and its own random draws, which are made as columns. Null and empty signals stay as they are."""

    @F.pandas_udf("array<double>")
    def mapped(column: pd.Series, drawn: pd.Series) -> pd.Series:
        return pd.Series([v if v is None or not len(v) else func(np.asarray(v, float), np.asarray(d)) for v, d in zip(column, drawn)], dtype=object)

    return mapped(x.cast("array<double>"), F.array(*draws))


def normal(*of: Column, seed: int = 0) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(1 - uniform(*of, seed=seed))) * F.cos(2 * np.pi * uniform(*of, seed=seed + 1))


def white_noise(x: Column, factor: float, key: list[str], pos: str = "pos", seed: int = 0) -> Column:
    return x + factor * F.stddev_pop(x).over(Window.partitionBy(*key)) * normal(*map(F.col, key), F.col(pos), seed=seed)


def noise(x: Column, key: list[str], pos: str = "pos", loc: float = 0.0, scale: float = 0.1, distribution: str = "gaussian", kind: str = "additive", relative: bool = True, seed: int = 0) -> Column:
    """Gaussian, Laplace or uniform noise, added or multiplied (as 1 + noise); relative to the range of the series if so asked."""
    of = (*map(F.col, key), F.col(pos))
    u = uniform(*of, seed=seed) - 0.5
    draw = {"gaussian": lambda: normal(*of, seed=seed), "laplace": lambda: -F.signum(u) * F.log(1 - 2 * F.abs(u) + 1e-300), "uniform": lambda: 2 * u}[distribution]()
    made = loc + scale * draw
    if kind == "multiplicative":
        return x * (1 + made)
    if kind != "additive":
        raise ValueError(f"unknown kind {kind}")
    w = Window.partitionBy(*key)
    return x + made * (F.max(x).over(w) - F.min(x).over(w)) if relative else x + made


def random_gain(x: Column, key: list[str], low: float = 0.1, high: float = 0.12, seed: int = 0) -> Column:
    return x * (low + (high - low) * uniform(*map(F.col, key), seed=seed))


def polarity_inverted(x: Column) -> Column:
    return -x


def pooled(x: Column, size: int, key: list[str], kind: str = "ave", pos: str = "pos") -> Column:
    w = Window.partitionBy(*key, F.floor(F.col(pos) / size))
    return {"ave": F.avg, "max": F.max, "min": F.min}[kind](x).over(w)


def quantized(x: Column, levels: int, key: list[str]) -> Column:
    """Uniform levels between the smallest and the largest value of a series."""
    w = Window.partitionBy(*key)
    a, b = F.min(x).over(w), F.max(x).over(w)
    step = F.floor(F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0)) * levels)
    return a + (F.least(step, F.lit(levels - 1)) + 0.5) * (b - a) / levels


def quantized_by_rank(df: DataFrame, column: str, levels: int, key: list[str]) -> DataFrame:
    """Levels of equally many samples in each series, each sample at the mean of its level."""
    level = F.least(F.floor(F.percent_rank().over(Window.partitionBy(*key).orderBy(column)) * levels), F.lit(levels - 1))
    return df.withColumn("_level", level).withColumn(column, F.avg(column).over(Window.partitionBy(*key, "_level"))).drop("_level")


def quantized_kmeans(x: Column, levels: int) -> Column:
    """On arrays: each sample at the mean of its cluster."""
    return on_arrays(lambda v: K.quantized_kmeans(v, levels))(x)


def dropped_out(x: Column, p: float, key: list[str], pos: str = "pos", fill: float | str = "ffill", size: int = 1, seed: int = 0) -> Column:
    """Runs of `size` samples dropped with probability p; filled with a value, the last kept one (ffill), the next kept one (bfill) or the mean of the kept ones."""
    kept = F.when(uniform(*map(F.col, key), F.floor(F.col(pos) / size), seed=seed) >= p, x)
    w = Window.partitionBy(*key).orderBy(pos)
    past, coming = F.last(kept, ignorenulls=True).over(w), F.first(kept, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if fill == "mean":
        return F.coalesce(kept, F.avg(kept).over(Window.partitionBy(*key)))
    if isinstance(fill, str):
        return {"ffill": F.coalesce(past, coming), "bfill": F.coalesce(coming, past)}[fill]
    return F.coalesce(kept, F.lit(fill))


def cropped(x: Column, size: int, *of: Column, seed: int = 0) -> Column:
    start = F.floor(uniform(*of, seed=seed) * (F.greatest(F.size(x) - size, F.lit(0)) + 1)).cast("int")
    return F.slice(x, start + 1, size)


def reversed_time(x: Column) -> Column:
    return F.reverse(x)


def convolved(x: Column, window: str = "hann", size: int = 7) -> Column:
    w = K.window(window, size, periodic=False)
    w = w / w.sum()
    return on_arrays(lambda v: np.convolve(np.pad(v, size // 2, "edge"), w, "valid")[: len(v)])(x)


def drifted(x: Column, *of: Column, most: float = 0.5, points: int = 3, seed: int = 0) -> Column:
    """A smooth random drift, relative to the range of the signal, drawn for each value of `of` (the key of a series)."""

    def drift(v: np.ndarray, draws: np.ndarray) -> np.ndarray:
        knots = np.cumsum(draws)
        d = K.cubic_spline(np.linspace(0, max(len(v) - 1, 1), points + 2), knots, np.arange(len(v)))
        d = d - d[:1]
        return v + d / max(np.abs(d).max(initial=0), 1e-12) * most * (v.max() - v.min())

    return _drawn(drift, x, [normal(*of, F.lit(i), seed=seed) for i in range(points + 2)])


def time_warped(x: Column, *of: Column, changes: int = 3, ratio: float = 3.0, seed: int = 0) -> Column:
    """Piecewise random speeds, length kept, drawn for each value of `of` (the key of a series)."""

    def warp(v: np.ndarray, draws: np.ndarray) -> np.ndarray:
        speed = 1 + (ratio - 1) * draws
        at = np.r_[0, np.cumsum(speed)] / speed.sum() * (len(v) - 1)
        return np.interp(np.interp(np.arange(len(v)), np.linspace(0, len(v) - 1, changes + 2), at), np.arange(len(v)), v)

    return _drawn(warp, x, [uniform(*of, F.lit(i), seed=seed) for i in range(changes + 1)])


def resized(x: Column, size: int) -> Column:
    """On arrays: linear interpolation to `size` samples."""
    return series.resized(x, F.lit(size))


def parts(x: Column, length: int, repeats: int | None = None) -> Column:
    """On arrays: consecutive full stretches of `length` samples, the first `repeats` of them or all."""
    full = F.floor(F.size(x) / length).cast("int")
    return F.slice(series.frames(x, length, length), 1, F.least(full, F.lit(repeats)) if repeats is not None else F.greatest(full, F.lit(0)))


def maybe(changed: Column, x: Column, prob: float, *of: Column, seed: int = 0) -> Column:
    """The changed value with probability `prob`, decided once for each value of the given columns."""
    return F.when(uniform(*of, seed=seed) < prob, changed).otherwise(x)


def augmented(df: DataFrame, steps: list[Callable[[DataFrame, int], DataFrame]], repeats: int = 1) -> DataFrame:
    """The original (repeat 0) and `repeats` copies, each put through all steps in turn with its own seed."""
    copies = [reduce(lambda d, f, k=k: f(d, k), steps, df).withColumn("repeat", F.lit(k)) for k in range(1, repeats + 1)]
    return reduce(DataFrame.unionByName, copies, df.withColumn("repeat", F.lit(0)))
