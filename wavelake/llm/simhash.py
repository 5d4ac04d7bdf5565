"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits = 8 positional bytes. Two fingerprints that differ in at most 4 bits share at least 4 of
their 8 positional bytes: that is the guaranteed minimum of matches. The index posts each distinct fingerprint under
20 triples of positional bytes (the smallest family of triples of 8 positions that meets every set of 4), so any such
pair meets in at least one posting list of 2**24 values. For each pair that meets, the shared positional bytes are
tallied; pairs below the minimum go, the rest are verified by the count of differing bits. A list is cut into blocks
and each pair of blocks is a unit of work, so that no list is gathered in one task, and of the verified links only a
spanning forest leaves a unit: links inside what is already connected add nothing to the components.

The pipeline's stage (`deduplicated`) needs all pairs with a similarity of 0.8 or more in runs of five words. It takes
the same steps: fingerprints of the runs, posting lists by triples of byte positions, the tally of shared positional
bytes with the same minimum (`posted`), and the similarity of whole sets as what is verified. Pairs at 0.8 lie up to 14
bits apart on sf0.1 and some share no byte, so that fingerprints can't find them all: what they leave apart also meets
in lists by bands of the sets' smallest hashes, which adds links and takes none away.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows and equal texts share
a fingerprint; a null id gets the component of its fingerprint; an empty table gives an empty result; other columns
of the input are ignored by `fingerprints` and may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, first_id, fold, materialize, ordered_node, sized, words

BITS = 4
#: Rows of a posting list that are compared at once with as many others.
BLOCK = 2048
#: Near copies of the pipeline: runs of this many words, similarity of their sets.
WORDS, SIMILAR = 5, 0.8
#: Bands of smallest hashes that near copies meet in: at the least similarity a pair is missed with probability (1 - 0.8 ** 4) ** 40 = 7e-10.
BANDS, BAND = 40, 4
#: Bands whose lists are worked through first.
FIRST = 4
#: Members of sets in a block of a list.
TOKENS = 1 << 19


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions such that every 4 positions hold one of them (three groups of 3, 3 and 2: triples inside a group, and two of a group with one of the next)."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = {g for g in groups if len(g) == 3}
    for i, g in enumerate(groups):
        out |= {tuple(sorted((*two, one))) for two in itertools.combinations(g, 2) for one in groups[(i + 1) % 3]}
    return sorted(out)


TRIPLES = _triples()


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text's shingles of `size` words, repeats included."""
    found = [w.encode() for w in words(fold(text or ""))]
    if not found:
        return 0
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        hashes = [digest(whole, 42)]
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        hashes = [digest(whole[a:b], 42) for a, b in zip((ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist())]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each row of `docs`; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links a[i]-b[i], those that connect what was not connected yet."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def _linked(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each run of equal keys."""
    octets, found, lag = fps.view(np.uint8).reshape(-1, 8), [], 0
    at = np.arange(len(keys))
    while len(at):
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        tally = (octets[at] == octets[at + lag]).sum(1)
        x = at[tally >= 8 - bits]
        x = x[np.bitwise_count(fps[x] ^ fps[x + lag]) <= bits]
        found.append(np.stack([fps[x], fps[x + lag]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
    both = both[:, both[0] != both[1]]
    return both[0].view(np.int64), both[1].view(np.int64)


def lists(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(post, unit, ...) sorted by unit and fp: the rows of `fps` (column fp) in the posting lists of their triples of bytes, cut into pairs of blocks."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)
    posts = fps.select("*", F.explode(F.array(*(F.shiftleft(F.lit(k).cast("long"), 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for k, (a, b, c) in enumerate(TRIPLES)))).alias("post"))
    large = posts.groupBy("post").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64(*fps.columns), F.col("blocks")).cast("int")
    units = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j)))
    work = posts.join(large.select("post", "blocks"), "post", "left").select("post", F.explode(units).alias("unit"), *fps.columns)
    return work.repartition("post", "unit").sortWithinPartitions("post", "unit", "fp")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of `lists`, all longs, in stretches of whole units of two rows or more."""
    rest = None
    for b in itertools.chain(batches, [None]):
        if b is None:
            full, rest = rest, None
        else:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            full = new if rest is None else np.concatenate([rest, new], axis=1)
            if not full.shape[1]:
                continue
            same = (full[0] == full[0, -1]) & (full[1] == full[1, -1])
            cut = len(same) - np.argmin(same[::-1]) if not same.all() else 0
            full, rest = full[:, :cut], full[:, cut:]
        if full is not None and full.shape[1] > 1:
            yield full


def _numbered(full: np.ndarray) -> np.ndarray:
    """The number of each row's unit."""
    return np.cumsum(np.r_[True, (full[0, 1:] != full[0, :-1]) | (full[1, 1:] != full[1, :-1])])


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(src, dst): links that span every group of distinct fingerprints (column fp) joined by at most `bits` (<= 4) differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in _units(batches):
            left, right = _forest(*_linked(_numbered(full), np.ascontiguousarray(full[2]).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["src", "dst"])

    return lists(fps.select("fp"), block).mapInArrow(run, "src long, dst long")


def _sharing(keys: np.ndarray, fps: np.ndarray, least: int) -> np.ndarray:
    """Which rows share `least` positional bytes or more with another row of their run of equal keys."""
    octets, hit, lag = fps.view(np.uint8).reshape(-1, 8), np.zeros(len(keys), bool), 0
    at = np.arange(len(keys))
    while len(at):
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        new = at[~(hit[at] & hit[at + lag])]
        new = new[(octets[new] == octets[new + lag]).sum(1) >= least]
        hit[new] = hit[new + lag] = True
    return hit


def posted(rows: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(row, n, post): the rows of `rows` (row, n, fp) in the lists of their triples, where they share 8 - `bits` positional bytes or more with another row of the list. Any two rows that share as many are together in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in _units(batches):
            hit = _sharing(_numbered(full), np.ascontiguousarray(full[4]).view(np.uint64), 8 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(full[i][hit]) for i in (2, 3, 0)], ["row", "n", "post"])

    # a list of several units names a row in each of them
    return lists(rows.select("row", "n", "fp"), block).mapInArrow(run, "row long, n long, post long").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable through links between fingerprints of at most `bits` differing bits."""
    own = materialize(fingerprints(docs, id_col, text_col, size), "simhash-fp")
    single = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-single")
    found = links(single.select("fp"), bits)
    ends = [single.select(F.col("fp").alias(end), ordered_node("first", "fp").alias(f"{end}_node")) for end in ("src", "dst")]
    found = found.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    root = connected_components(found, "simhash-cc").select(F.col("node.own").alias("fp"), F.col("component").alias("root"))
    # written, so that a fingerprint with very many rows can be split in the join
    named = materialize(single.join(root, "fp", "left").select("fp", F.coalesce(first_id("root"), "first").alias("component_id")), "simhash-named")
    discard(single)
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's runs of `size` words, in rising order; a shorter text is one run, one without words has none."""
    found = [w.encode() for w in words(fold(text or ""))]
    if not found:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(whole, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    return np.unique(np.fromiter((digest(whole[a:b], 42) for a, b in zip((ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist())), np.uint64, len(found) - size + 1))


_PICK = np.random.default_rng(7)
_XOR, _ODD = _PICK.integers(0, 1 << 32, (BANDS * BAND, 1), np.uint32), _PICK.integers(0, 1 << 31, (BANDS * BAND, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _PICK.integers(0, 1 << 62, (BANDS, BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of BAND smallest hashes of a set of shingles; two sets share a band's key with probability similarity ** BAND."""
    if not len(found):
        return np.zeros(0, np.int64)
    low, least = (found ^ (found >> np.uint64(32))).astype(np.uint32), np.full(BANDS * BAND, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        x = (low[at : at + 1024] ^ _XOR) * _ODD
        x ^= x >> np.uint32(15)
        least = np.minimum(least, (x * np.uint32(0x85EBCA6B)).min(1))
    key = ((least.reshape(BANDS, BAND).astype(np.uint64) + np.uint64(1)) * _MIX).sum(1, dtype=np.uint64)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _spanning(ids: np.ndarray, lengths: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links that span what pairs of sets of similarity `least` join. `ids`: the members of all sets, numbered from 0, in one array."""
    ends = np.cumsum(lengths)
    flag, rest, flat = np.zeros(int(ids.max()) + 1, bool), np.arange(len(lengths)), ids
    queue, left, right = [], [], []
    while len(rest):
        if queue:
            x = queue.pop()
        else:
            x = int(rest[0])
            rest, flat = rest[1:], flat[lengths[x] :]
            if not len(rest):
                break
        own, size = ids[ends[x] - lengths[x] : ends[x]], lengths[rest]
        flag[own] = True
        same = np.add.reduceat(flag[flat], np.cumsum(size) - size, dtype=np.int64)
        flag[own] = False
        hit = same >= least * (lengths[x] + size - same) - 1e-9
        if hit.any():
            found = rest[hit].tolist()
            left += [x] * len(found)
            right += found
            queue += found
            rest, flat = rest[~hit], flat[np.repeat(~hit, size)]
    return left, right


def similar(sets: DataFrame, posts: DataFrame, least: float = SIMILAR, tokens: int = TOKENS) -> DataFrame:
    """(src, dst): links that span every group of rows joined by similarities of `least` or more among those that share a post. `sets`: row, found (binary); `posts`: row, n (size of the set), post."""
    lists = posts.groupBy("post").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("row")).alias("rows")).where("m > 1")
    # lists of the same rows are worked through once
    lists = lists.groupBy("rows", "m", "n").agg(F.min("post").alias("post")).select("post", F.ceil(F.col("n") / tokens).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    work = posts.join(lists, "post").select("post", "row", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j))).alias("unit")).join(sets, "row").select("post", "unit", "row", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in itertools.chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            post, unit = t["post"].to_numpy(), t["unit"].to_numpy()
            cut = t.num_rows if b is None else t.num_rows - int(((post == post[-1]) & (unit == unit[-1])).sum())
            rest = t.slice(cut)
            if not cut:
                continue
            begin = np.flatnonzero(np.r_[True, (post[1:cut] != post[: cut - 1]) | (unit[1:cut] != unit[: cut - 1])])
            row, found, left, right = t["row"].to_numpy(), t["found"], [], []
            for a, z in zip(begin.tolist(), np.r_[begin[1:], cut].tolist()):
                if z - a > 1:
                    each = [np.frombuffer(x, np.uint64) for x in found.slice(a, z - a).to_pylist()]
                    i, j = _spanning(np.unique(np.concatenate(each), return_inverse=True)[1], np.array([len(x) for x in each]), least)
                    left += row[a:z][i].tolist()
                    right += row[a:z][j].tolist()
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["src", "dst"])

    return work.repartition("post", "unit").sortWithinPartitions("post", "unit").mapInArrow(run, "src long, dst long")


def near_copies(rows: DataFrame, size: int = WORDS, least: float = SIMILAR, by_bands: bool = True) -> DataFrame:
    """(row, root) for each row of `rows` (row, text): the rows of one root are joined by texts whose sets of runs of `size` words have a similarity (Jaccard) of `least` or more. Texts without words are one group.

    Without `by_bands`, by fingerprints alone: no link is lost between sets whose fingerprints share 8 - BITS positional bytes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [shingles(t.as_py(), size) for t in b.column(1)]
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in each], pa.binary())
            fps = np.fromiter(map(majority, each), np.uint64, len(each)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.array([len(x) for x in each], pa.int64()), pa.array(fps), pa.array([bands(x) for x in each], pa.list_(pa.int64()))], ["row", "key", "n", "fp", "posts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in b.column(1)], pa.binary())], ["row", "found"])

    index = materialize(rows.select("row", "text").mapInArrow(describe, "row long, key binary, n long, fp long, posts array<long>"), "near-index")
    # equal sets are compared once
    single = materialize(index.groupBy("key").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("fp").alias("fp")), "near-distinct")
    by_bytes = materialize(posted(single.where("n > 0")), "near-bytes")
    posts = index.join(single.select("row"), "row").select("row", "n", F.posexplode("posts" if by_bands else F.array().cast("array<long>")).alias("band", "post"))
    met = posts.groupBy("post").agg(F.count("*").alias("m")).where("m > 1").select("post")
    posts = materialize(posts.join(met, "post"), "near-posts")
    some = materialize(by_bytes.select("row").union(posts.select("row")).distinct(), "near-met")
    text = rows.join(sized(some), "row", "left_semi").select("row", "text")
    sets = materialize(text.mapInArrow(gather, "row long, found binary"), "near-sets")
    # fingerprints and the first bands find most links; of the others, lists whose rows are all connected by then add nothing
    edges = materialize(similar(sets, by_bytes.unionByName(posts.where(F.col("band") < FIRST).select("row", "n", "post")), least), "near-edges")
    root = materialize(connected_components(edges, "near-cc"), "near-roots")
    rest = posts.where(F.col("band") >= FIRST).join(root, posts.row == root.node, "left").select("row", "n", "post", F.coalesce("component", "row").alias("root"))
    rest = materialize(rest, "near-rest")
    apart = rest.groupBy("post").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("post")
    more = materialize(similar(sets, rest.join(apart, "post").select("row", "n", "post"), least), "near-edges")
    root = connected_components(root.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more), "near-cc")
    named = materialize(single.join(root, single.row == root.node, "left").select("key", F.coalesce("component", "row").alias("root")), "near-named")
    discard(by_bytes, posts, some, sets, edges, rest, more, single)
    return index.select("row", "key").join(named, "key").select("row", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each group of near copies (see near_copies): that of the smallest id, and of equal ids the first; a null id stays only where the group has no other."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    named = rows.select(F.col("_row").alias("row"), F.col(id_col).cast("long").alias("doc_id")).join(near_copies(rows.select(F.col("_row").alias("row"), F.col(text_col).cast("string").alias("text"))), "row")
    named = materialize(named, "near-groups")
    keep = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    drop = materialize(named.join(keep, "row", "left_anti").select(F.col("row").alias("_row")), "near-drop")
    discard(named)
    return rows.join(sized(drop), "_row", "left_anti").select(*docs.columns)
