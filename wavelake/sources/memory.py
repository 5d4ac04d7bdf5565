"""Series from and to driver-side arrays, and files with column roles. What comes to the driver has to fit there: these are the edges of the engine, for small inputs and for results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import SeriesFrame
from . import loaders


def from_numpy(spark: SparkSession, x: np.ndarray, y: np.ndarray | None = None, names: Sequence[str] | None = None, targets: Sequence[str] | None = None) -> SeriesFrame:
    """(rows, channels), or (series, rows, channels): one series or several of equal length. `y`: one row for each row of x, or one for each series."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    x = x[None] if x.ndim == 2 else x
    if x.ndim != 3:
        raise ValueError(f"one to three dimensions are understood, not {x.ndim}")
    series, rows, width = x.shape
    names = list(names or (f"ch_{i}" for i in range(width)))
    if len(names) != width:
        raise ValueError(f"{len(names)} names for {width} channels")
    data = {"series": np.repeat(np.arange(series), rows), "pos": np.tile(np.arange(rows), series)} | {n: x[:, :, i].ravel() for i, n in enumerate(names)}
    given: list[str] = []
    if y is not None:
        y = np.asarray(y)
        y = y[:, None] if y.ndim == 1 else y
        if len(y) not in (series, series * rows):
            raise ValueError(f"{len(y)} targets for {series} series of {rows} rows")
        y = y if len(y) == series * rows else np.repeat(y, rows, axis=0)
        given = list(targets or (f"y_{i}" for i in range(y.shape[1])))
        data |= {n: y[:, i] for i, n in enumerate(given)}
    return SeriesFrame(spark.createDataFrame(pa.table(data)), ("series",), tuple(names), tuple(given))


def from_pandas(spark: SparkSession, frames: pd.DataFrame | Sequence[pd.DataFrame], targets: Sequence[str] = (), ids: Sequence | None = None) -> SeriesFrame:
    """One frame or one for each series (named by `ids` or numbered); columns but the targets are channels."""
    each = [frames] if isinstance(frames, pd.DataFrame) else list(frames)
    if not each:
        raise ValueError("no frames")
    if any(list(f.columns) != list(each[0].columns) for f in each):
        raise ValueError("all frames need the same columns")
    named = list(ids) if ids is not None else list(range(len(each)))
    if len(named) != len(each):
        raise ValueError(f"{len(named)} ids for {len(each)} frames")
    whole = pd.concat([f.assign(series=i, pos=np.arange(len(f))) for i, f in zip(named, each)], ignore_index=True)
    channels = [c for c in each[0].columns if c not in targets]
    return SeriesFrame(spark.createDataFrame(pa.Table.from_pandas(whole, preserve_index=False)), ("series",), tuple(channels), tuple(targets))


def from_dict(spark: SparkSession, data: Mapping[str, Sequence], targets: Sequence[str] = ()) -> SeriesFrame:
    """Columns of one series."""
    return from_pandas(spark, pd.DataFrame(dict(data)), targets)


def from_list(spark: SparkSession, arrays: Sequence, y: Sequence | None = None, names: Sequence[str] | None = None, ids: Sequence | None = None) -> SeriesFrame:
    """Arrays (rows, channels) of any lengths, one for each series, with one target for each."""
    each = [np.asarray(a, float).reshape(len(a), -1) for a in arrays]
    width = {a.shape[1] for a in each}
    if len(width) != 1:
        raise ValueError(f"all series need the same channels, found {sorted(width)}")
    columns = list(names or (f"ch_{i}" for i in range(width.pop())))
    frames = [pd.DataFrame(a, columns=columns) for a in each]
    if y is not None:
        if len(y) != len(each):
            raise ValueError(f"{len(y)} targets for {len(each)} series")
        frames = [f.assign(y=v) for f, v in zip(frames, y)]
    return from_pandas(spark, frames, ["y"] if y is not None else [], ids)


def to_pandas(s: SeriesFrame) -> pd.DataFrame:
    """All roles, in the order of key and position."""
    return s.df.select(*s.columns).orderBy(*s.key, s.pos).toPandas()


def to_list(s: SeriesFrame) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, X, y) of each series."""
    return [(k if isinstance(k, tuple) else (k,), f[list(s.channels)].to_numpy(float), f[list(s.targets)].to_numpy()) for k, f in to_pandas(s).groupby(list(s.key), sort=True)]


def to_numpy(s: SeriesFrame) -> tuple[np.ndarray, np.ndarray]:
    """X and y of one series, or of several of equal length with one more dimension in front."""
    each = to_list(s)
    if len({len(x) for _, x, _ in each}) > 1:
        raise ValueError("the series differ in length: use to_list")
    x, y = (np.stack([e[i] for e in each]) if each else np.zeros((0, 0, len(s.channels if i == 1 else s.targets))) for i in (1, 2))
    return (x[0], y[0]) if len(each) == 1 else (x, y)


def to_dict(s: SeriesFrame) -> dict[str, list]:
    return to_pandas(s).to_dict("list")


def load_file(spark: SparkSession, path: str, channels: Sequence[str] | None = None, targets: Sequence[str] = (), **options) -> SeriesFrame:
    """One CSV or WAV file as a series with roles; without `channels` all columns but the targets are."""
    if path.lower().endswith(".wav"):
        folder, _, name = path.rpartition("/")
        found = loaders.wav_dir(spark, folder or ".", **options).where(F.col("id") == name)
        return _sounds(found)
    df = loaders.csv_file(spark, path, **options).withColumn("series", F.lit(0))
    names = tuple(channels or (c for c in df.columns if c not in ("series", "pos", *targets)))
    return SeriesFrame(df.select("series", "pos", *names, *targets), ("series",), names, tuple(targets))


def load_dir(spark: SparkSession, path: str, kind: str = "csv", channels: Sequence[str] | None = None, classes: list[str] | None = None, **options) -> SeriesFrame:
    """CSV or WAV files below `path`: a series for each (label, id), the folder as target."""
    if kind == "wav":
        return _sounds(loaders.wav_dir(spark, path, classes, **options))
    if kind != "csv":
        raise ValueError(f"series come from csv or wav files, not {kind}")
    df = loaders.csv_dir(spark, path, list(channels) if channels else None, classes, **options)
    names = tuple(c for c in df.columns if c not in ("label", "id", "pos"))
    return SeriesFrame(df.withColumn("class", F.col("label")), ("label", "id"), names, ("class",))


def _sounds(df: DataFrame) -> SeriesFrame:
    """Sounds as samples of the first two channels (a missing second one is null); files that can't be read are left out."""
    wide = df.where("error is null").select("label", "id", "sr", F.posexplode(F.arrays_zip(F.col("channels")[0].alias("ch_0"), F.get("channels", F.lit(1)).alias("ch_1"))).alias("pos", "x"))
    rows = wide.select("label", "id", F.col("pos").cast("long"), F.col("x.ch_0").alias("ch_0"), F.col("x.ch_1").alias("ch_1"), F.col("label").alias("class"), "sr")
    return SeriesFrame(rows, ("label", "id"), ("ch_0", "ch_1"), ("class", "sr"))
