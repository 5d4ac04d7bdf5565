"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where ids are put in order: after all others.
NO_ID = 2**63 - 1
#: Parts of a node's edges in a join.
SALTS = 4
#: Narrow rows (a number, a hash with its few spans) that are broadcast at most: some tens of MB.
BROADCAST_ROWS = 500_000


def words(text: str) -> list[str]:
    """Words of a text; what str.split() would cut at besides (other Unicode spaces, information separators) stays inside a word."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fold(text: str) -> str:
    """Lower-case A-Z alone."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) one of this machine."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("wavelake.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavelake-")
        spark.conf.set("wavelake.scratch.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` into the shared folder and read it back, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that `materialize` made and that no plan reads any more. What a returned plan still reads stays, for the owner of the shared folder to clear."""
    for df in stored:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._stored)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows for a join: broadcast if it has `most` rows at most, shuffled beyond that."""
    return F.broadcast(df) if df.count() <= most else df.hint("shuffle_hash")


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row. Null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Smallest node that each node of `edges` (src, dst; of any type with an order, structs included) reaches, as (node, component).

    Alternating large-star and small-star rounds: each is a map-side combined minimum for a node and one join,
    so a node with very many links is never gathered in one list. Each round is written to the shared folder, and the
    one before it deleted.
    """
    e = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), name)
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _salted(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted(large, low).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        before, e = e, materialize(small.where("u <> v").distinct(), name)
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _salted(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the minimum of their node u, in SALTS parts of each node, so that a node with very many edges is spread (and can be split further)."""
    parts = low.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(parts, ["u", "salt"]).drop("salt")


def ordered_node(first: str, own: str) -> Column:
    """A node of `connected_components` for a group of rows: its smallest id, then its own number. The component's first field is the smallest id of all, with no join by component. Null ids come last."""
    return F.struct(F.coalesce(F.col(first), F.lit(NO_ID)).alias("first"), F.col(own).alias("own"))


def first_id(node: str) -> Column:
    return F.nullif(F.col(f"{node}.first"), F.lit(NO_ID))
