"""Embedding near-duplicates through a pivot-permutation index.

Pivots are a hashed sample of the vectors, their number growing with the square root of the table. Each vector is
described by its nearest pivots in order (8 of up to 256 pivots, one more for each doubling, so that the recall does
not fall as the table grows); two vectors closer than the threshold share most of them. Two sets of k pivots that share
3 or more share two of the k - 1 that come first in any fixed order, so with the rarest pivots first a vector is posted
under its k - 1 rarest only. An inverted list is named by the first pivot that two vectors share, and, where lists
would grow beyond LIST rows, also by a part of the second one (`parts` of them: 1 in a small table, up to every pivot
by itself in a huge one), so a vector is sent k - 2 times in a small table. A pair is taken up only in the list of the
first two posted pivots that it shares, its shared pivots are counted, and the cosine is verified in double precision.
Lists are cut into blocks, and each pair of blocks is a unit of work; what leaves it are counts of links for each
vector and a spanning forest of them. Equal vectors are described and compared once, with their number.

The index is approximate: a link is lost only if the two share fewer than 3 of their nearest pivots. Where so few
pivots remain that vectors can't be posted (few or very dense vectors), all are compared with all in blocks, and no
link is lost. Every vector is indexed; tests measure the recall against brute force.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most,
link with nothing, and neither count as anyone's link; a null id is carried, and doesn't name a component unless no
other does; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, first_id, materialize, ordered_node
from .simhash import _forest

NEAREST, SHARED = 8, 3
MOST_PIVOTS = 4096
#: Rows of a list that are compared at once with as many others, and rows that a list should have at most.
BLOCK, LIST = 2048, 4096
#: The key of all rows where fewer pivots remain than a vector is posted under.
ALL = -1


def nearest_of(pivots: int) -> int:
    """How many of its nearest pivots describe a vector: NEAREST up to 256 pivots, one more for each doubling."""
    return NEAREST + max(0, int(np.ceil(np.log2(max(pivots, 1) / 256))))


def _matrix(column: pa.Array) -> np.ndarray:
    """A row for each list; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread(drawn: np.ndarray, count: int, apart: float = 0.7) -> np.ndarray:
    """Up to `count` of the drawn unit vectors, none within a cosine of `apart` of another: a dense group gets one pivot, else its members would be told apart by chance."""
    kept, n = np.empty((count, drawn.shape[1])), 0
    for x in drawn:
        if n < count and not (kept[:n] @ x > apart).any():
            kept[n] = x
            n += 1
    return kept[:n]


def described(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """(row, vector, near): the numbers of the nearest pivots, nearest first."""
    given = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                close = _unit(_matrix(b.column(1))) @ given.value.T
                near = np.argsort(-close, axis=1, kind="stable")[:, :nearest].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int32()))], ["row", "vector", "near"])

    return vectors.select("row", "vector").mapInArrow(run, f"row long, vector {vectors.schema['vector'].dataType.simpleString()}, near array<int>")


def _ranked(near: DataFrame, rank: np.ndarray) -> DataFrame:
    """`near` with the pivots named by their rank, in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = np.sort(rank[_matrix(b.column(2)).astype(np.int64)], axis=1).astype(np.int32) if b.num_rows else np.zeros((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(ranks.ravel()), ranks.shape[1]).cast(pa.list_(pa.int32()))], ["row", "vector", "near"])

    return near.select("row", "vector", "near").mapInArrow(run, near.select("row", "vector", "near").schema)


def _pairs(x: np.ndarray, near: np.ndarray, own: np.ndarray, diagonal: bool, key: tuple[int, int] | None, least: float, shared: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one unit of work that are linked and taken up under this key. `near` has the pivots by rarity, the posted ones first."""
    if diagonal:
        i, j = np.nonzero(np.triu(_close(x, x, least), 1))
    else:
        a, b = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
        i, j = np.nonzero(_close(x[a], x[b], least))
        i, j = a[i], b[j]
    kept = []
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        mine = (x[a] * x[b]).sum(1) >= least
        if key is not None:
            same = (near[a][:, :, None] == near[b][:, None, :]).any(2)
            head = near.shape[1] - shared + 2
            posted = (near[a][:, :head, None] == near[b][:, None, :head]).any(2)
            # of the posted pivots that both share, the first two are this key
            first = np.argmax(posted, axis=1)
            rest = posted.copy()
            rest[np.arange(len(a)), first] = False
            second = np.argmax(rest, axis=1)
            mine &= (near[a, first] == key[0]) & (near[a, second] % parts == key[1]) & rest.any(1) & (same.sum(1) >= shared)
        kept.append(np.flatnonzero(mine) + at)
    k = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return i[k], j[k]


def _close(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """What may reach the threshold: single precision with room for its error, verified afterwards."""
    return a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(least - 1e-4)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal (post, unit)."""
    rest = None
    for b in itertools.chain(batches, [None]):
        t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if t is None or not t.num_rows:
            continue
        post, unit = t["post"].to_numpy(), t["unit"].to_numpy()
        same = (post == post[-1]) & (unit == unit[-1])
        cut = t.num_rows if b is None else t.num_rows - int(same.sum())
        rest = t.slice(cut).combine_chunks()
        if cut:
            yield t.slice(0, cut).combine_chunks()


def links(index: DataFrame, least: float, shared: int = SHARED, block: int = BLOCK, nearest: int = NEAREST, parts: int = 1) -> DataFrame:
    """(src, dst, n): with src = dst, n linked vectors of a row (weighted by their number, column k); else a link of the spanning forest. `index`: row, k, vector, near by rarity (as ranks)."""
    posted = nearest - shared + 2
    keys = F.array_distinct(F.array(*(F.shiftleft(F.col("near")[a].cast("long"), 20) + F.col("near")[b] % parts for a, b in itertools.combinations(range(posted), 2))))
    # too few pivots tell nothing apart: all rows meet under one key
    posts = index.select("row", F.explode(F.when(F.size("near") >= posted, keys).otherwise(F.array(F.lit(ALL).cast("long")))).alias("post"))
    large = posts.groupBy("post").agg(F.count("*").alias("m")).where("m > 1").select("post", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    work = posts.join(large, "post").withColumn("own", mine)
    work = work.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j))))
    work = work.select("post", "unit", "own", F.expr("unit div blocks = unit % blocks").alias("diagonal"), "row").join(index.select("row", "k", "vector", "near"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            post, unit, own, diagonal, row, k = (t[c].to_numpy() for c in ("post", "unit", "own", "diagonal", "row", "k"))
            x, near = _unit(_matrix(t["vector"].combine_chunks())), _matrix(t["near"].combine_chunks()).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, (post[1:] != post[:-1]) | (unit[1:] != unit[:-1])])
            end = np.r_[begin[1:], len(post)]
            left, right = [], []
            for a, z in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
                i, j = _pairs(x[a:z], near[a:z], own[a:z], bool(diagonal[a]), None if post[a] == ALL else (int(post[a]) >> 20, int(post[a]) & 0xFFFFF), least, shared, parts)
                if len(i):
                    left.append(i + a)
                    right.append(j + a)
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                names, where = np.unique(np.concatenate([row[i], row[j]]), return_inverse=True)
                n = np.bincount(where, np.concatenate([k[j], k[i]])).astype(np.int64)
                src, dst = _forest(row[i], row[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[names, np.array(src, np.int64)]), pa.array(np.r_[names, np.array(dst, np.int64)]), pa.array(np.r_[n, np.zeros(len(src), np.int64)])], ["src", "dst", "n"])

    return work.repartition("post", "unit").sortWithinPartitions("post", "unit").mapInArrow(run, "src long, dst long, n long")


def parts_of(rows: int, pivots: int, nearest: int, shared: int = SHARED, most: int = LIST) -> int:
    """Parts of the second pivot so that a list of the first one has about `most` rows."""
    return int(min(max(pivots, 1), -(-rows * max(nearest - shared + 1, 1) // (max(pivots, 1) * most)) or 1))


def components(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int | None = None, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`."""
    value = F.col(vector_col)
    sound = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "pivots-rows")
    common = own.where("sound").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    bare = lambda rows: rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return bare(own)
    good = F.col("sound") & (F.size("vector") == common["n"])
    single = own.where(good).groupBy("vector").agg(F.min("row").alias("row"), F.min("vec_id").alias("first"), F.count("*").alias("k"))
    single = materialize(single, "pivots-distinct")
    rows = single.count()
    count = min(int(2 ** np.ceil(np.log2(max(16.0, np.sqrt(rows))))), MOST_PIVOTS)
    drawn = single.orderBy(F.xxhash64("row"), "row").limit(2 * count).select("vector").toArrow()["vector"].combine_chunks()
    chosen = spread(_unit(_matrix(drawn)), count)
    nearest = nearest or nearest_of(len(chosen))
    near = materialize(described(single, chosen, nearest), "pivots-near")
    # the rarest pivots come first: at most MOST_PIVOTS numbers
    load = np.zeros(len(chosen), np.int64)
    for r in near.select(F.explode("near").alias("p")).groupBy("p").count().collect():
        load[r["p"]] = r["count"]
    rank = np.empty(len(chosen), np.int64)
    rank[np.lexsort((np.arange(len(chosen)), load))] = np.arange(len(chosen))
    index = _ranked(near, rank).join(single.select("row", "k"), "row")
    found = materialize(links(index, least, shared, nearest=nearest, parts=parts_of(rows, len(chosen), nearest, shared)), "pivots-links")
    discard(near)
    number = found.where("src = dst").groupBy(F.col("src").alias("row")).agg(F.sum("n").alias("n"))
    forest = found.where("src <> dst")
    ends = [single.select(F.col("row").alias(end), ordered_node("first", "row").alias(f"{end}_node")) for end in ("src", "dst")]
    forest = forest.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    root = connected_components(forest, "pivots-cc").select(F.col("node.own").alias("row"), F.col("component").alias("root"))
    named = single.join(root, "row", "left").join(number, "row", "left")
    named = named.select("vector", F.coalesce(first_id("root"), "first").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"))
    # written, so that a vector with very many rows can be split in the join
    named = materialize(named, "pivots-named")
    discard(found, single)
    out = own.where(good).join(named, "vector").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out.unionByName(bare(own.where(~good)))
