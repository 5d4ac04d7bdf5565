"""Ranks and row numbers over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

BUCKETS = 256


def bucket(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """Ordered buckets of about equal size of a numeric column; equal values share one. The bounds are an array of `buckets` numbers at most, taken by a job."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, BooleanType)):
        raise TypeError(f"{column} is a {kind.simpleString()}: only numbers and times can be dealt into buckets")
    marks = df.agg(F.percentile_approx(F.col(column).cast("double"), [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0]
    marks = sorted(set(marks or []))
    return F.size(F.filter(F.array(*map(F.lit, marks)).cast("array<double>"), lambda m: m <= F.col(column).cast("double")))


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, n, before) of each distinct value but null: its rows, and those with smaller values. Values are counted first, then added up within buckets and over the few buckets, so no task sees all of them."""
    own = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    own = own.withColumn("_b", bucket(own, column))
    whole = own.groupBy("_b").agg(F.sum("n").alias("_n"))
    offset = whole.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_o"))  # a row for each bucket
    within = F.sum("n").over(Window.partitionBy("_b").orderBy(column)) - F.col("n")
    return own.withColumn("_w", within).join(F.broadcast(offset), "_b").select(column, "n", (F.col("_o") + F.col("_w")).alias("before"))


def positioned(df: DataFrame, order: Column, *then: str | Column, name: str = "_at") -> DataFrame:
    """Row numbers from 0 by a numeric first key, ties broken by the others. Rows are sorted within buckets of the first key; many rows that share one value of it share a task."""
    own = df.withColumn("_o", order)
    own = own.withColumn("_b", bucket(own, "_o"))
    whole = own.groupBy("_b").agg(F.count("*").alias("_n"))
    offset = whole.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_f"))  # a row for each bucket
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_o", *then)) - 1
    return own.withColumn(name, within).join(F.broadcast(offset), "_b").withColumn(name, F.col(name) + F.col("_f")).drop("_o", "_b", "_f")


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] = ()) -> DataFrame:
    """(by, q): the exact quantiles, linear between neighbours, of each class as an array. Values are counted first and placed by buckets, so neither a class nor the whole table is held by one task or buffer."""
    by = list(by)
    own = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    own = own.withColumn("_b", bucket(own, "_v"))
    whole = own.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    # a row for each bucket of a class
    offset = whole.select(*by, "_b", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_o"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    placed = own.withColumn("_w", F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v")) - F.col("_n"))
    same = [placed[c].eqNullSafe(offset[c]) for c in by] + [placed["_b"] == offset["_b"]]
    placed = placed.join(offset, same).select(*(placed[c] for c in by), "_v", (F.col("_o") + F.col("_w")).alias("_at"), F.col("_n").alias("_k"), (F.col("_all") - 1).alias("_last")) if by else placed.join(F.broadcast(offset.withColumnRenamed("_n", "_m")), "_b").select("_v", (F.col("_o") + F.col("_w")).alias("_at"), F.col("_n").alias("_k"), (F.col("_all") - 1).alias("_last"))
    ends = []
    for p in probabilities:
        t = F.round(F.lit(float(p)) * F.col("_last"), 9)
        at = lambda i: F.max(F.when((F.col("_at") <= i) & (i < F.col("_at") + F.col("_k")), F.col("_v")))
        low, high, share = at(F.floor(t)), at(F.ceil(t)), F.max(t - F.floor(t))
        ends.append(low + (high - low) * share)
    return placed.groupBy(*by).agg(F.array(*ends).alias("q"))
