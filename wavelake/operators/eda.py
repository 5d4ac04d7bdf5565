"""Exploratory operators: correlation, outliers, scaling, label codes."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import columns as C
from .ordering import bucket, positioned, value_ranks
from .ordering import quantiles as exact_quantiles


def with_average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by its rank, ties sharing their mean; a null stays null."""
    for c in columns:
        ranks = value_ranks(df, c).select(F.col(c).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias("_r"))
        df = df.join(ranks, df[c] == F.col("_v"), "left").withColumn(c, F.col("_r")).drop("_v", "_r")
    return df


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) of each pair, in one aggregation (kendall: one for each pair)."""
    pairs = list(itertools.combinations(columns, 2))
    if method == "kendall":
        return reduce(DataFrame.unionByName, (kendall(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("tau").alias("r")) for a, b in pairs))
    if method == "spearman":
        df = with_average_ranks(df.select(*columns), columns)
    elif method != "pearson":
        raise ValueError(f"unknown method {method}; pearson, spearman and kendall are supported")
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs)).alias("x"))
    return row.select(F.inline("x"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b, exact, without pairs of rows.

    The rank of b is read bit by bit: two rows with different ranks first differ at one level, where one has a 0 and
    the other a 1 under the same prefix. So at each level and prefix it is enough to add up, in the order of a, the
    ones and zeros that came before; buckets of a share that work. Counts of equal rows are taken first."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("n"))
    spread = g.withColumn("_bucket", bucket(g, "x")).join(value_ranks(g.select("y"), "y").select("y", F.col("before").alias("_r")), "y")
    bits = F.sequence(F.lit(0), F.lit(62))
    top = g.agg(F.count("*").alias("k")).select(F.greatest(F.ceil(F.log2(F.col("k") + 1)), F.lit(1)).cast("int").alias("_top"))
    level = spread.crossJoin(F.broadcast(top)).select("x", "n", "_bucket", "_r", F.explode(F.slice(bits, F.lit(1), F.col("_top"))).alias("level"))  # one row
    level = level.withColumn("_one", F.expr("shiftright(_r, level) & 1")).withColumn("prefix", F.expr("shiftright(_r, level + 1)"))
    sums = level.groupBy("level", "prefix", "_bucket", "x").agg(F.sum(F.col("n") * F.col("_one")).alias("o"), F.sum(F.col("n") * (1 - F.col("_one"))).alias("z"))
    whole = sums.groupBy("level", "prefix", "_bucket").agg(F.sum("o").alias("_o"), F.sum("z").alias("_z"))
    past = Window.partitionBy("level", "prefix").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("level", "prefix", "_bucket", *(F.coalesce(F.sum(c).over(past), F.lit(0.0)).alias(c) for c in ("_o", "_z")))
    near = Window.partitionBy("level", "prefix", "_bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumns({f"_{c}w": F.coalesce(F.sum(c).over(near), F.lit(0.0)) for c in ("o", "z")})
    s = local.join(whole, ["level", "prefix", "_bucket"]).agg(F.sum(F.col("o") * (F.col("_z") + F.col("_zw")) - F.col("z") * (F.col("_o") + F.col("_ow"))).alias("s"))
    tied = lambda c: g.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t{c}"))
    total = g.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("t"))
    # four tables of one row
    return s.join(tied("x")).join(tied("y")).join(total).select(F.try_divide(F.col("s"), F.sqrt((F.col("t") - F.col("tx")) * (F.col("t") - F.col("ty")))).alias("tau"))


def highly_correlated(df: DataFrame, columns: list[str], threshold: float = 0.75, method: str = "pearson") -> list[str]:
    """Members of any pair with an absolute correlation of the threshold or more, in column order."""
    hit = {c for r in correlation(df, columns, method).where(F.abs("r") >= threshold).collect() for c in (r.a, r.b)}
    return [c for c in columns if c in hit]


def keep_highly_correlated(df: DataFrame, columns: list[str], threshold: float = 0.75, method: str = "pearson") -> DataFrame:
    """Only those of the columns that `highly_correlated` names, beside all others."""
    kept = highly_correlated(df, columns, threshold, method)
    return df.select(*(c for c in df.columns if c in kept or c not in columns))


def redundant(df: DataFrame, columns: list[str], threshold: float = 0.75) -> list[str]:
    """Columns that correlate with an earlier one at the threshold or more."""
    hit = {r.b for r in correlation(df, columns).where(F.abs("r") >= threshold).collect()}
    return [c for c in columns if c in hit]


def z_score_kept(df: DataFrame, columns: list[str], by: str, threshold: float = 3) -> DataFrame:
    """Rows whose values all lie within `threshold` standard deviations of their class; a constant column keeps nothing. One aggregation by class, joined back."""
    stats = df.groupBy(F.col(by).alias("_by")).agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns))
    inside = F.lit(True)
    for c in columns:
        inside = inside & (F.abs(F.try_divide(F.col(c) - F.col(f"_{c}.m"), F.col(f"_{c}.s"))) < threshold)
    return df.join(stats, F.col(by).eqNullSafe(F.col("_by"))).where(F.coalesce(inside, F.lit(False))).select(*(df[c] for c in df.columns))


def statistics(df: DataFrame, column: str, by: list[str], ddof: int = 0) -> DataFrame:
    """All statistical and energy features of each class, the exact median included."""
    stats = df.groupBy(*by).agg(*(c.alias(k) for k, c in C.statistics(F.col(column), ddof).items()))
    median = exact_quantiles(df, column, [0.5], by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("q")[0].alias("median"))
    return stats.join(median, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)), "left").drop(*(f"_{c}" for c in by))


def iqr_kept(df: DataFrame, columns: list[str], by: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Rows inside the whiskers of their class for all columns: exact quantiles by class, joined back."""
    out = df
    for c in columns:
        q = exact_quantiles(df, c, [low, high], [by]).select(F.col(by).alias("_by"), F.col("q").alias(f"_{c}"))
        a, b = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        out = out.join(q, F.col(by).eqNullSafe(F.col("_by"))).where(F.col(c).between(a - 1.5 * (b - a), b + 1.5 * (b - a))).select(df.columns)
    return out


def standardized(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    stats = df.groupBy(*by).agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns))
    wide = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row
    return wide.select(*(((F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.s") == 0, 1.0).otherwise(F.col(f"_{c}.s"))).alias(c) if c in columns else F.col(c) for c in df.columns))


def min_max_scaled(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high]; a constant column becomes low."""
    stats = df.agg(*(F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(f"_{c}") for c in columns))
    scale = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_{c}.a"), F.col(f"_{c}.b") - F.col(f"_{c}.a")), F.lit(0.0)) * (high - low) + low
    return df.crossJoin(F.broadcast(stats)).select(*(scale(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes of the sorted labels: (label, code). Labels are numbered within buckets (of strings by their first bytes), not in one task."""
    own = df.select(F.col(column).alias("label")).where("label is not null").distinct()
    text = isinstance(own.schema["label"].dataType, StringType)
    order = F.conv(F.rpad(F.substring(F.hex("label"), 1, 12), 12, "0"), 16, 10).cast("double") if text else F.col("label").cast("double")
    return positioned(own, order, "label", name="code")


def label_decoded(df: DataFrame, codes: DataFrame, code: str, into: str) -> DataFrame:
    """The inverse of `label_codes`: the label of each code."""
    return df.join(codes.select(F.col("code").alias("_code"), F.col("label").alias(into)), F.col(code) == F.col("_code"), "left").drop("_code")


def imputed(df: DataFrame, columns: list[str], sentinel: float | None = None) -> DataFrame:
    """Nulls, and `sentinel` if one is given, become the mean of the other values."""
    sound = lambda c: F.when(F.col(c) != sentinel, F.col(c)) if sentinel is not None else F.col(c)
    stats = df.agg(*(F.avg(sound(c)).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(stats)).select(*(F.coalesce(sound(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))  # one row


def quantile_transformed(df: DataFrame, column: str, quantiles: int = 1000, into: str | None = None) -> DataFrame:
    """Values mapped to [0, 1] by the empirical distribution: `quantiles` exact landmarks, linear between them; equal landmarks give the middle of their range. The landmarks are one array of a bounded length."""
    steps = [k / (quantiles - 1) for k in range(quantiles)]
    marks = exact_quantiles(df, column, steps).select(F.col("q").alias("_m"))
    x, m = F.col(column).cast("double"), F.col("_m")
    low = F.size(F.filter(m, lambda v: v < x))
    high = F.size(F.filter(m, lambda v: v <= x))
    between = low - 1 + (x - F.get(m, low - 1)) / (F.get(m, low) - F.get(m, low - 1))
    place = F.when(high > low, (low + high - 1) / 2).when(low == 0, 0.0).when(low == quantiles, float(quantiles - 1)).otherwise(between)
    ends = F.when(x <= F.get(m, F.lit(0)), 0.0).when(x >= F.get(m, F.lit(quantiles - 1)), 1.0).otherwise(place / float(quantiles - 1))
    name = into or column
    return df.crossJoin(F.broadcast(marks)).withColumn(name, F.when(x.isNotNull(), ends)).drop("_m")  # one row


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each label that occurs on either side."""
    both = confusion_matrix(df, truth, predicted)
    sides = both.select(F.inline(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("hit")),
    )))
    own = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    hit = F.col("hit")
    return own.select("label", ratio(hit, F.col("named")).alias("precision"), ratio(hit, F.col("support")).alias("recall"), ratio(2 * hit, F.col("named") + F.col("support")).alias("f1"), "support")


def regression_report(df: DataFrame, truth: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """(rmse, mae, r2) over all rows or each group."""
    e = F.col(truth) - F.col(predicted)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(truth))).alias("r2"))
