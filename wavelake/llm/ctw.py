"""Language-model scores by context-tree weighting over bytes, beside an additive-smoothed unigram base score.

Each byte is decomposed into 8 binary decisions, and each decision has a context tree over the DEPTH bytes before it.
Every node holds a Krichevsky-Trofimov estimate from the corpus counts; the weighted probability of a node mixes its own
estimate with the product of its children's, half and half, from the deepest contexts up to the empty one. The
posterior weights of that mixture give, for each context, the probability of each next byte across all depths, and the
sum over a text is its code length. At a decision that training has not seen in a context, the mixture ends with the
deepest context in which it has.

There is one way at every size. (DEPTH+1)-grams of bytes are counted in tasks and then by key; those of held-out
texts are carried with count 0. A gram is written with the nearest byte first, so that in rising order all contexts of all
depths are runs. The levels from DEPTH to GROUP are worked out in tasks, by runs of equal contexts of GROUP bytes (at
most 256 ** (DEPTH - GROUP + 1) grams each), the levels above by sums and joins by key, up to the root and down again.
The result is a table of the log probability of every gram that occurs in the corpus. Of it, as of the words, the most
frequent entries (HOT_GRAMS, HOT_WORDS) are broadcast, and what else a text holds is joined by key: nothing that grows
with the corpus is broadcast or brought to the driver, and no joined key is hot.

Defined cases: a null text is empty, and scores only its end in the base score and 0 in the model; without training
texts every decision is even; repeated rows and null ids (fold 0) are scored each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, discard, fold, materialize, words

#: Bytes of context (6 at most: a gram is one long), and of the contexts that are worked out together.
DEPTH, GROUP = 6, 4
HOT_GRAMS, HOT_WORDS = 1 << 22, 1 << 17
#: No word: words hold no line feed.
END = "\n"
#: Bytes that are looked up or counted at once; distinct grams and words that a task keeps before it passes counts on; grams whose nodes are worked out at once.
CHUNK, KEPT_GRAMS, KEPT_WORDS, NODES = 1 << 20, 2_000_000, 250_000, 100_000


def grams_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of all texts, flat, with zeros before a text, and the length of each text. A gram has the nearest byte of the context first and the byte itself last."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    back = (b"".join(bytes(depth) + t for t in texts))[::-1] + bytes(9)
    n = len(back) - 9
    # read backwards, the bytes after a byte are those before it: eight of them at once
    before = np.ndarray((n,), ">u8", back, 1, (1,)).astype(np.uint64)
    before >>= np.uint64(64 - 8 * depth)
    before <<= np.uint64(8)
    before |= np.frombuffer(back, np.uint8, n)
    gram, real = before.view(np.int64)[::-1], np.ones(n, bool)
    starts = np.cumsum(lengths + depth) - lengths - depth
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return gram[real], lengths


def _counted(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in rising order, and how often each occurs."""
    gram = np.sort(gram)
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.diff(np.r_[first, len(gram)])


def _summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of grams in rising order with counts, repeats added up."""
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(n, first) if len(first) else n


def _parts(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of texts of about `size` bytes, with the place of the first."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def gram_counts(docs: DataFrame, text_col: str = "text", learn_col: str = "learn", depth: int = DEPTH) -> DataFrame:
    """(gram, n): how often each gram occurs in the texts to be learned (column `learn`), 0 if only in others. Tasks send each of their grams about once, so no key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, rest = np.zeros(0, np.int64), np.zeros(0, np.int32), {True: [], False: []}

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000]), pa.array(sums[at : at + 50_000].astype(np.int64))], ["gram", "n"])

        for b in itertools.chain((whole.slice(i, 250) for whole in batches for i in range(0, whole.num_rows, 250)), [None]):
            if b is not None:
                for t, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rest[learn].append((t or "").encode())
                if sum(map(len, itertools.chain(*rest.values()))) < CHUNK:
                    continue
            for learn, texts in rest.items():
                for _, part in _parts(texts):
                    gram, n = _counted(grams_of(part, depth)[0])
                    gram, n = np.concatenate([keys, gram]), np.concatenate([sums, n.astype(np.int32) * learn])
                    order = np.argsort(gram, kind="stable")  # two runs, merged
                    keys, sums = _summed(gram[order], n[order])
                    del gram, n, order
                    if len(keys) > KEPT_GRAMS:
                        yield from rows()
                        keys, sums = keys[:0].copy(), sums[:0].copy()
                texts.clear()
        yield from rows()

    given = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(learn_col).cast("boolean"), F.lit(False)).alias("learn"))
    return given.mapInArrow(run, "gram long, n long").repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n): occurrences of each word and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
        for whole in batches:
            for b in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                for t in b.column(0).to_pylist():
                    seen.update(words(fold(t or "")))
                seen[END] += b.num_rows
                if len(seen) > KEPT_WORDS:
                    yield rows()
                    seen = Counter()
        yield rows()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = np.arange(1 << 12, dtype=float)
_HALF, _WHOLE = _log_gamma(_SMALL + 0.5), _log_gamma(_SMALL + 1)


def _looked_up(n: np.ndarray, known: np.ndarray, plus: float) -> np.ndarray:
    out = known[np.minimum(n, len(known) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(known))
    out[large] = _log_gamma(n[large] + plus)
    return out


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _looked_up(zeros, _HALF, 0.5) + _looked_up(ones, _HALF, 0.5) - np.log(np.pi) - _looked_up(zeros + ones, _WHOLE, 1.0)


def _above(node):
    """The node one level up: without the farthest byte of its context. Of arrays and columns alike."""
    if isinstance(node, Column):
        return F.shiftleft(F.shiftright(node, 16), 8) + node.bitwiseAND(255)
    return (node >> 16 << 8) | (node & 255)


class Levels:
    """The nodes of sorted grams from the deepest level up to `group`: key (context, then decision), zeros, ones, log of the weighted probability, weight of the own estimate, and where the node above is."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, group: int):
        context, byte, n = gram >> 8, gram & 255, n.astype(float)
        key = np.concatenate([context << 8 | 1 << k | byte >> (8 - k) for k in range(8)])
        bit = np.concatenate([byte >> (7 - k) & 1 for k in range(8)])
        node, self.own = np.unique(key, return_inverse=True)
        self.bit, many = bit, np.tile(n, 8)
        zeros, ones, below = np.bincount(self.own, many * (1 - bit), len(node)), np.bincount(self.own, many * bit, len(node)), None
        self.levels, self.up = [], []
        for d in range(depth, group - 1, -1):
            kt = _kt(zeros, ones)
            mass = kt if below is None else np.logaddexp(kt, below) - np.log(2)
            self.levels.insert(0, (node, zeros, ones, mass, np.ones(len(node)) if below is None else np.exp(kt - np.log(2) - mass)))
            if d > group:
                node, up = np.unique(_above(node), return_inverse=True)
                self.up.insert(0, up)
                zeros, ones, below = (np.bincount(up, x, len(node)) for x in (zeros, ones, mass))

    def chances(self, add: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each gram, from what the levels above give for each node of the first level: the sum so far, the share that they leave, and their mixture."""
        for i, (_, zeros, ones, _, weight) in enumerate(self.levels):
            if i:
                up = self.up[i - 1]
                add, share, p = add[up], share[up], p[up]
            own = (ones + 0.5) / (zeros + ones + 1)
            p = np.where(zeros + ones > 0, add + share * own, p)
            add, share = add + share * weight * own, share * (1 - weight)
        # none is surer than single precision can tell from 1
        p = np.clip(p, 2.0**-25, 1 - 2.0**-25)[self.own]
        return np.log10(np.where(self.bit == 1, p, 1 - p)).reshape(8, -1).sum(0)


def _runs(batches: Iterator[pa.RecordBatch], column: str, shift: int, least: int = NODES) -> Iterator[pa.Table]:
    """Tables of about `least` rows or more that end where the leading bytes of a column do."""
    held, n = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n < least:
                continue
        if not n:
            continue
        t = pa.concat_tables(held).combine_chunks()
        part = t[column].to_numpy() >> shift
        cut = n if b is None else int(np.searchsorted(part, part[-1]))
        held, n = ([t.slice(cut)], n - cut) if cut < n else ([], 0)
        if cut:
            yield t.slice(0, cut).combine_chunks()


_NODE = "code long, n long, zeros double, ones double, mass double, weight double"


def _nodes(*columns: np.ndarray) -> pa.RecordBatch:
    code, rest = columns[0], columns[1:]
    return pa.RecordBatch.from_arrays([pa.array(code), pa.nulls(len(code), pa.int64()), *map(pa.array, rest)], ["code", "n", "zeros", "ones", "mass", "weight"])


def chances(known: DataFrame, depth: int = DEPTH, group: int = GROUP) -> DataFrame:
    """(gram, logs, n): the log10 probability of the byte of each of the `known` grams (gram, n) in its context. A written table."""
    shift = 8 * (depth - group + 1)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "gram", shift):
            gram, n = t["gram"].to_numpy(), t["n"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), *(pa.nulls(len(gram), pa.float64()) for _ in range(4))], ["code", "n", "zeros", "ones", "mass", "weight"])
            yield _nodes(*Levels(gram, n, depth, group).levels[0])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, zeros, ones, below = (c.to_numpy() for c in b.columns)
            kt = _kt(zeros, ones)
            mass = np.logaddexp(kt, below) - np.log(2)
            yield _nodes(code, zeros, ones, mass, np.exp(kt - np.log(2) - mass))

    first = materialize(known.repartition(F.shiftright("gram", shift)).sortWithinPartitions("gram").mapInArrow(deep, _NODE), "ctw-nodes")
    grams, nodes, stored = first.where(F.col("n").isNotNull()).select("code", "n"), [first.where(F.col("n").isNull())], [first]
    for _ in range(group):
        sums = nodes[0].groupBy(_above(F.col("code")).alias("code")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "mass")))
        stored.append(materialize(sums.mapInArrow(weighed, _NODE), "ctw-nodes"))
        nodes.insert(0, stored[-1])
    own, seen = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1), F.col("zeros") + F.col("ones") > 0
    given = nodes[0].select("code", (F.col("weight") * own).alias("add"), (1 - F.col("weight")).alias("share"), F.when(seen, own).otherwise(0.5).alias("p"))
    for level in nodes[1:]:
        here = level.withColumn("above", _above(F.col("code"))).join(given.withColumnRenamed("code", "above"), "above")
        above = here.select("code", "add", "share", "p")  # for the last level, what those above it give
        given = here.select("code", (F.col("add") + F.col("share") * F.col("weight") * own).alias("add"), (F.col("share") * (1 - F.col("weight"))).alias("share"), F.when(seen, F.col("add") + F.col("share") * own).otherwise(F.col("p")).alias("p"))
    # a node of the last level, a context of `group` bytes and a decision, comes before the grams of its context
    nothing = F.lit(None).cast("double")
    tops = above.select(F.shiftleft(F.shiftright("code", 8), shift).alias("at"), "code", F.lit(None).cast("long").alias("n"), "add", "share", "p")
    both = tops.unionByName(grams.select(F.col("code").alias("at"), "code", "n", nothing.alias("add"), nothing.alias("share"), nothing.alias("p")))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "at", shift):
            gram = t["n"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
            code, n, add, share, p = (t[c].combine_chunks() for c in ("code", "n", "add", "share", "p"))
            code, n, (add, share, p) = code.to_numpy(), n.drop_null().to_numpy(), (x.drop_null().to_numpy() for x in (add, share, p))
            order = np.argsort(code[~gram])  # the order of the levels
            logs = Levels(code[gram], n, depth, group).chances(add[order], share[order], p[order])
            yield pa.RecordBatch.from_arrays([pa.array(code[gram]), pa.array(logs.astype(np.float32)), pa.array(n)], ["gram", "logs", "n"])

    out = materialize(both.repartition(F.shiftright("at", shift)).sortWithinPartitions("at").mapInArrow(finished, "gram long, logs float, n long"), "ctw-chances")
    discard(*stored)
    return out


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count n for which `most` rows at most have it or more, from a histogram of a few hundred steps."""
    step = F.floor(F.log2(F.col("n") + 1) * 8)
    held = 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.max("n").alias("most")).orderBy(F.desc("step")).collect():
        held += r["k"]
        if held > most:
            return r["most"] + 1
    return 0


def score(gram: np.ndarray, logs: np.ndarray, texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """log10 probability of each text but for the grams that are not among the given ones (sorted), and those."""
    out, away = np.zeros(len(texts)), [np.zeros(0, np.int64)] * len(texts)
    for at, part in _parts(texts, CHUNK // 2):
        own, lengths = grams_of(part, depth)
        order = np.argsort(own)
        found = own[order]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else order
        where = np.searchsorted(gram, found[first])
        where[where == len(gram)] = 0
        known = gram[where] == found[first] if len(gram) else np.zeros(len(first), bool)
        # not a number: elsewhere
        value, each = np.full(len(first), np.nan, np.float32), np.empty(len(own), np.float32)
        value[known] = logs[where[known]]
        each[order] = np.repeat(value, np.diff(np.r_[first, len(found)]))
        far = np.isnan(each)
        each = np.where(far, 0, each).astype(float)
        ends = np.r_[0, np.cumsum(lengths)]
        out[at : at + len(part)] = np.diff(np.r_[0, np.cumsum(each)][ends])
        far = np.flatnonzero(far)
        cuts = np.searchsorted(far, ends)
        away[at : at + len(part)] = [own[far[a:z]] for a, z in zip(cuts, cuts[1:])]
    return out, away


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = DEPTH, group: int = GROUP, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes): a row for each row of `docs`. Learns from the rows outside fold 0."""
    context = docs.sparkSession.sparkContext
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (bucket_of(id_col, folds) != 0).alias("learn"))
    tokens = materialize(word_counts(given.where("learn")), "ctw-words")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot_words = tokens.where(F.col("n") >= _least(tokens, HOT_WORDS)).select("token", "n").toArrow()
    model = chances(gram_counts(given, depth=depth), depth, group)
    least = _least(model, hot_grams)
    hot = model.where(F.col("n") >= least).select("gram", "logs").toArrow()
    order = np.argsort(hot["gram"].to_numpy())
    shared = context.broadcast((hot_words, hot["gram"].to_numpy()[order], hot["logs"].to_numpy()[order]))
    del hot, hot_words, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, gram, logs = shared.value
        log = dict(zip(hot["token"].to_pylist(), np.log10(hot["n"].to_numpy() + 0.1).tolist()))
        for whole in batches:
            for b in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                texts = [t or "" for t in b.column(1).to_pylist()]
                out = []
                for t in texts:
                    found = words(fold(t))
                    found.append(END)
                    got = list(map(log.get, found))
                    cold = [w for w, x in zip(found, got) if x is None] if None in got else []
                    out.append((len(found), len(found) - len(cold), sum(filter(None, got)), cold))
                n, seen, sums, cold = zip(*out)
                raw = [t.encode() for t in texts]
                own, away = score(gram, logs, raw, depth)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums, pa.float64()), pa.array(cold, pa.list_(pa.string())), pa.array(own), pa.array(away, pa.list_(pa.int64())), pa.array(list(map(len, raw)), pa.int64())], ["doc_id", "n_tokens", "seen", "sums", "cold", "score", "away", "bytes"])

    schema = "doc_id long, n_tokens long, seen long, sums double, cold array<string>, score double, away array<long>, bytes long"
    own = materialize(given.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "ctw-scores")
    cold = own.select("row", F.explode("cold").alias("token")).join(tokens, "token", "left")
    cold = cold.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.count("n").alias("also"))
    # every gram of every text is in the model
    away = own.select("row", F.explode("away").alias("gram")).join(model.where(F.col("n") < least).select("gram", "logs"), "gram")
    away = away.groupBy("row").agg(F.sum(F.col("logs").cast("double")).alias("rest"))
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    out = own.join(cold, "row", "left").join(away, "row", "left")
    return out.select("doc_id", (bucket_of("doc_id", folds) == 0).alias("held_out"), "n_tokens", (F.col("seen") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"), "bytes")
