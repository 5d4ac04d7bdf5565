"""Event detection in probabilities, and interval-based scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.columns import safe


def above(p: Column, threshold: float) -> Column:
    return F.when(p > threshold, p).otherwise(F.lit(0.0))


def runs(df: DataFrame, key: list[str], value: str, pos: str = "pos") -> DataFrame:
    """Maximal runs of positive values as half-open intervals: key, start, end."""
    part = Window.partitionBy(*key).orderBy(pos)
    island = F.col(pos) - F.row_number().over(part)
    return df.where(F.col(value) > 0).withColumn("_i", island).groupBy(*key, "_i").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_i")


def lasting(events: DataFrame, sr: float, seconds: float) -> DataFrame:
    return events.where(F.col("end") - F.col("start") >= int(sr * seconds))


def silenced(df: DataFrame, events: DataFrame, key: list[str], value: str, pos: str = "pos") -> DataFrame:
    """Values outside all events become 0: the sample counts of the events, spread over their positions, are joined back by key and position, so long events need no range join."""
    inside = events.select(*key, F.explode(F.sequence("start", F.col("end") - 1)).alias(pos), F.lit(True).alias("_in")).distinct()
    return df.join(inside, [*key, pos], "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(0.0))).drop("_in")


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def classified(predicted: DataFrame, truth: DataFrame, key: list[str], least: float, width: int = 256) -> DataFrame:
    """Each predicted event with its best true one and a verdict: insertion, deletion, correct or substitution. Needs an `id`, unique within a key, in both. Events meet in the stretches of `width` positions that both touch, a pair in the first of them alone, so a key with very many events is no quadratic join."""
    touched = lambda a, z: F.explode(F.sequence(F.floor(a / width), F.floor((F.greatest(z, a + 1) - 1) / width)))
    t = truth.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("cls").alias("_c"), F.col("id").alias("_id"))
    t = t.withColumn("_bin", touched(F.col("_s"), F.col("_e")))
    p = predicted.select(*key, "id", "start", "end").withColumn("bin", touched(F.col("start"), F.col("end")))
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("bin") == F.col("_bin"), F.col("start") < F.col("_e"), F.col("_s") < F.col("end")]
    pairs = p.join(t, on).where(F.col("bin") == F.floor(F.greatest("start", "_s") / width)).withColumn("iou", iou(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")))
    best = pairs.groupBy(*key, "id").agg(F.max_by(F.struct("_c", "iou"), F.struct("iou", -F.col("_id"))).alias("b"))
    verdict = F.when(F.col("b").isNull() | (F.col("b.iou") == 0), "insertion").when(F.col("b.iou") < least, "deletion").when(F.col("b._c") == F.col("cls"), "correct").otherwise("substitution")
    return predicted.join(best, [*key, "id"], "left").select(*key, "id", "start", "end", "cls", F.coalesce("b.iou", F.lit(0.0)).alias("iou"), verdict.alias("verdict"))


def scores(verdicts: DataFrame, key: list[str]) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    c, i, d, s = n("correct"), n("insertion"), n("deletion"), n("substitution")
    return verdicts.groupBy(*key).agg(
        i.alias("insertions"), c.alias("corrects"), s.alias("substitutions"), d.alias("deletions"),
        safe(c.cast("double"), d + c + s).alias("dr"), safe(c.cast("double"), c + i).alias("reliability"), safe((d + i + s).cast("double"), d + c + s).alias("erer"),
    )


def prediction_statistics(p: DataFrame, instance: str = "instance", repeat: str = "repeat", cls: str = "cls", value: str = "p") -> DataFrame:
    """Class, mean probability of it, spread and entropy of each instance over its repeats."""
    by_class = p.groupBy(instance, cls).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.var_pop(value).alias("var"))
    best = by_class.groupBy(instance).agg(F.max_by(F.struct(cls, "m", "sd", "var"), F.struct("m", -F.col(cls))).alias("b"))
    each = p.groupBy(instance, repeat).agg(F.sum(-F.col(value) * F.log2(F.col(value) + 1e-12)).alias("h")).groupBy(instance).agg(F.avg("h").alias("entropy"))
    return best.join(each, instance).select(instance, F.col(f"b.{cls}").alias("predicted"), F.col("b.m").alias("mean_pred"), F.col("b.sd").alias("std"), F.col("b.var").alias("variance"), "entropy")


def true_events(files: DataFrame, classes: list[str], sr: float | None = None, key: str = "file", items: str = "items") -> DataFrame:
    """(key, id, start, end, cls) from rows with an array of structs (start, end, label, type). Times (type `time`) become samples; a label that isn't among the classes has no class."""
    each = files.select(key, F.posexplode(items).alias("id", "e"))
    at = lambda x: F.when(F.col("e.type") == "time", (x * (sr or 1.0)).cast("long")).otherwise(x.cast("long"))
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("e.label")).cast("int") - 1
    return each.select(key, "id", at(F.col("e.start")).alias("start"), at(F.col("e.end")).alias("end"), F.when(code >= 0, code).alias("cls"))


def probabilities(df: DataFrame, vector: str, predict: Callable[[np.ndarray], np.ndarray], repeats: int = 1) -> DataFrame:
    """A row for each row of `df`, repeat and class: (columns but the vector, repeat, cls, p). `predict` maps a matrix (rows, features) to one of (rows, classes), a batch at a time; it is called anew for each repeat, so models with dropout differ between them."""
    kept = [c for c in df.columns if c != vector]
    inner = df.select(*kept, F.col(vector).cast("array<double>").alias("_v"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack([np.asarray(v, float) for v in part["_v"]]) if len(part) else np.zeros((0, 1))
            for r in range(repeats if len(part) else 0):
                yield part[kept].assign(repeat=r, p=np.asarray(predict(x), float).tolist())

    schema = inner.select(*kept).schema.add("repeat", T.IntegerType()).add("p", T.ArrayType(T.DoubleType()))
    return inner.mapInPandas(run, schema).select(*kept, "repeat", F.posexplode("p").alias("cls", "p"))


def interpolated(p: DataFrame, key: list[str], sr: float, seconds: float, overlap: float, at: str = "middle", cutoff: float | None = None, instance: str = "instance", value: str = "p") -> DataFrame:
    """(key, pos, value): window probabilities on the sample grid by a not-a-knot spline, and a low pass of order 3 if there is a cutoff. `at`: whether a window stands for the start, the middle or the end of its hop. One array for each key, so classes belong into the key."""
    size = int(seconds * sr)
    hop = size - int(size * overlap)
    shift = {"start": 0, "middle": hop // 2, "end": hop}[at]

    @F.pandas_udf("array<double>")
    def curve(column: pd.Series) -> pd.Series:
        out = []
        for y in column:
            fine = K.cubic_spline(np.arange(len(y)) * hop + shift, np.asarray(y, float), np.arange(len(y) * hop))
            out.append((K.butterworth(fine, sr, "lowpass", cutoff, 3) if cutoff else fine).tolist())
        return pd.Series(out, dtype=object)

    packed = p.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(instance, value))).alias("_x"))
    return packed.select(*key, F.posexplode(curve(F.col(f"_x.{value}"))).alias("pos", value)).withColumn("pos", F.col("pos").cast("long"))


def robustness(p: DataFrame, truth: DataFrame, key: list[str], sr: float, seconds: float, overlap: float, cutoff: float, threshold: float = 0.7, shortest: float = 1.0, least_iou: float = 0.5, at: str = "middle") -> dict[str, DataFrame]:
    """All of it for any number of series at once, from (key, instance, repeat, cls, p) and true events (key, id, start, end, cls): `statistics` of the repeats, `smoothed` and `thresholded` curves, `events`, and `scores` of the series. Each is a plan of its own; what isn't used isn't computed."""
    mean = p.groupBy(*key, "cls", "instance").agg(F.avg("p").alias("p"))
    smoothed = interpolated(mean, [*key, "cls"], sr, seconds, overlap, at, cutoff)
    loud = smoothed.withColumn("p", above(F.col("p"), threshold))
    found = lasting(runs(loud, [*key, "cls"], "p"), sr, shortest).withColumn("id", F.col("start"))
    verdicts = classified(found, truth, key, least_iou)
    one = F.struct(*key, F.col("instance"))
    return {
        "statistics": prediction_statistics(p.withColumn("instance", one)).select("instance.*", "predicted", "mean_pred", "std", "variance", "entropy"),
        "smoothed": smoothed,
        "thresholded": silenced(loud, found, [*key, "cls"], "p"),
        "events": verdicts,
        "scores": scores(verdicts, key),
    }
