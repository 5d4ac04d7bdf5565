"""Relational operators on tables of samples or events: set operations, as-of joins, gap filling, top k, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def present(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the other table has (semi-join)."""
    return df.join(other, key, "left_semi")


def absent(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the other table lacks, null keys included (anti-join)."""
    return df.join(other, key, "left_anti")


def shared_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows of both tables."""
    return df.select(*other.columns).intersect(other)


def own_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that the other table lacks."""
    return df.select(*other.columns).subtract(other)


def as_of(df: DataFrame, other: DataFrame, key: list[str], at: str, columns: list[str], past: str = "past_") -> DataFrame:
    """Each row with the other table's columns from its last row of the same key at or before `at` (null: none). One sort by key and time over both tables, no range join; ties of the other table go to the largest values."""
    tagged = df.select("*", F.struct(*(F.lit(None).cast(other.schema[c].dataType).alias(c) for c in columns)).alias("_other"), F.lit(1).alias("_side"))
    theirs = other.select(*(F.col(c) if c in [*key, at] else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns), F.struct(*columns).alias("_other"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*key).orderBy(at, "_side", "_other").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tagged.unionByName(theirs).withColumn("_last", F.last(F.when(F.col("_side") == 0, F.col("_other")), ignorenulls=True).over(order))
    return found.where("_side = 1").select(*df.columns, *(F.col(f"_last.{c}").alias(f"{past}{c}") for c in columns))


def filled(df: DataFrame, column: str, key: list[str], pos: str = "pos") -> DataFrame:
    """Nulls become the last value before them in their series, at its beginning the next one."""
    w = Window.partitionBy(*key).orderBy(pos)
    before, after = F.last(column, ignorenulls=True).over(w), F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(before, after))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in the given order: each task sends k rows at most."""
    return df.orderBy(*order).limit(k)


def pivoted(df: DataFrame, key: list[str], names: str, values: str, columns: list) -> DataFrame:
    """One row for each key, and a column with the mean of `values` for each of the given names."""
    return df.groupBy(*key).pivot(names, columns).agg(F.avg(values))


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by the columns, by all but the last, and so on up to the whole (rollup); `level` says how many columns are rolled up."""
    return df.rollup(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).withColumn("level", F.bit_count("_g").cast("long")).drop("_g")
