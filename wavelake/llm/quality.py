"""Bradley-Terry pairwise ranking of documents by quality.

Each text is described by lexical features, all built-in column expressions, written once as a table. All pairs of a
better and a worse labelled document give feature differences; a logistic loss on them, with an L2 penalty, gives the
weights, so that a weighted sum of features orders documents. The cut is the quantile of the training scores that the
share of worse documents names, and the reported score is a logistic curve through 0.3 at that cut: score >= 0.3 means
above the quantile.

Every labelled document of the training folds takes part, in means, scales, weights and cut, whatever their number, and
no pair is drawn or formed: a pair's loss depends on its two weighted sums alone, so each round of Newton's method adds
up, over narrow bins of weighted sums, what the documents of a class hold, and pairs bins instead of documents. The cut
is an exact order statistic.

Defined cases: null and empty texts have the features of an empty text and get a score; null labels teach nothing;
without both classes in the labels every score is 0.5 (nothing is rejected); repeated rows are scored each; an empty
table gives an empty result; extra columns are carried by `filtered` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, discard, materialize

#: Bins in a unit of the weighted sum: narrow ones for counts and sums of features, wide ones for their products (which steer the steps, not where they end).
NARROW, WIDE = 64, 8
#: Parts that a stretch of scores is cut into at once on the way to a quantile.
PARTS = 1000
#: Rows that are worked through at once.
ROWS = 10_000
CUT = 0.3


def features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n
    drop = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    spaced = F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " ")
    lines = F.split(t, "\n")
    count = F.greatest(F.size(spaced), F.lit(1)).cast("double")
    return {
        "upper": without(r"\p{Lu}+"),
        "letters": 1 - without(r"\p{L}+"),
        "digits": drop("0123456789"),
        "symbols": drop("#*$%&<>@^~=+"),
        "bars": drop("|"),
        "bangs": drop("!?"),
        "stops": drop(".,;:"),
        "word_length": F.log1p(n / count),
        "length": F.log1p(n),
        "new_words": F.size(F.array_distinct(spaced)) / count,
        "same_words": F.pow(F.size(F.array_distinct(spaced)) / F.sqrt(count), 0.5),
        "new_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_length": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
    }


@dataclass(frozen=True)
class Ranker:
    """Weights of the standardised features, the cut and the curve."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    slope: float

    def raw(self, columns: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for name, mean, scale, weight in zip(self.names, self.means, self.scales, self.weights):
            total = total + F.least(F.greatest((columns[name] - mean) / scale, F.lit(-8.0)), F.lit(8.0)) * weight
        return total

    def odds(self, columns: dict[str, Column]) -> Column:
        """How far the weighted sum is above the cut (at least 0: kept)."""
        return (self.raw(columns) - self.cut) * self.slope if any(self.weights) else F.lit(0.0)

    def score(self, odds: str) -> Column:
        """0 to 1 from a column of odds; at least CUT if they are 0 or more."""
        curve = 1 / (1 + F.exp(-F.col(odds)) * (1 / CUT - 1))
        return F.when(F.col(odds) >= 0, F.greatest(F.lit(CUT), curve)).otherwise(curve) if any(self.weights) else F.lit(0.5)


def pairs(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the better and the worse row of each pair that the loss is over: all of them. The fit is the same without forming them."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    return np.repeat(good, len(bad)), np.tile(bad, len(good))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of equal keys."""
    key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([np.zeros(0), *values]), len(key))


def tallied(z: np.ndarray, label: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows by bins of the weighted sum, as keys and values: of each class the count and the features by narrow bins, products of two features by wide ones. See `untallied` for keys."""
    s, (i, j), keys, values = z @ w, np.triu_indices(z.shape[1]), [], []
    for side in (0, 1):
        own, at = z[label == side], s[label == side]
        for kind, bins, of in ((0, NARROW, np.c_[np.ones(len(own)), own]), (1, WIDE, own[:, i] * own[:, j])):
            order = np.argsort(b := np.floor(at * bins).astype(np.int64))
            each, start = np.unique(b[order], return_index=True)
            keys.append((((kind * 2 + side) << 48) + ((each[:, None] + (1 << 31)) << 16) + np.arange(of.shape[1])).ravel())
            values.append(np.add.reduceat(of[order], start).ravel() if len(own) else np.zeros(0))
    return merged(keys, values)


def untallied(key: np.ndarray, value: np.ndarray, kind: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a kind and class, and the sums of each. A key holds the kind and class, the bin and the place among its sums."""
    own = (key >> 48) == kind * 2 + side
    each, at = np.unique(((key[own] >> 16) & 0xFFFFFFFF) - (1 << 31), return_inverse=True)
    place = key[own] & 0xFFFF
    out = np.zeros((len(each), int(place.max()) + 1))
    out[at, place] = value[own]
    return each, out


def slope(key: np.ndarray, value: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss over all pairs of a better and a worse row, its fall by weight, and its curvature, all from `tallied` sums. The rows of a narrow bin stand at their mean."""
    fine = [untallied(key, value, 0, side) for side in (1, 0)]
    (ng, zg), (nb, zb) = ((x[:, 0], x[:, 1:]) for _, x in fine)
    sg, sb = zg @ w / ng, zb @ w / nb
    all_pairs, loss, cross = ng.sum() * nb.sum(), 0.0, np.zeros((len(w), len(w)))
    fall, bend = [np.zeros(len(sg)), np.zeros(len(sb))], [np.zeros(len(sg)), np.zeros(len(sb))]
    for a in range(0, len(sg), 256):
        part = slice(a, a + 256)
        gap = np.clip(sg[part, None] - sb, -500, 500)
        lost = 1 / (1 + np.exp(gap))
        curve = lost * (1 - lost)
        loss += ng[part] @ np.logaddexp(0, -gap) @ nb
        fall[0][part], bend[0][part] = lost @ nb, curve @ nb
        fall[1] += ng[part] @ lost
        bend[1] += ng[part] @ curve
        cross += zg[part].T @ curve @ zb
    hess = -cross - cross.T
    for side, (bins, x), c in ((1, fine[0], bend[0]), (0, fine[1], bend[1])):
        each, products = untallied(key, value, 1, side)
        at = np.searchsorted(each, bins // (NARROW // WIDE))
        mean = np.bincount(at, c * x[:, 0], len(each)) / np.bincount(at, x[:, 0], len(each))
        half = np.zeros_like(hess)
        half[np.triu_indices(len(w))] = mean @ products
        hess += half + np.triu(half, 1).T
    return loss / all_pairs, (fall[0] @ zg - fall[1] @ zb) / all_pairs, hess / all_pairs


def newton(total: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, penalty: float, rounds: int) -> np.ndarray:
    """Weights of the least loss; total(w): the `tallied` sums of all rows at weights w. A step that makes it worse is halved."""
    best, least = np.zeros(width), np.inf
    w = best
    for _ in range(rounds):
        loss, grad, hess = slope(*total(w), w)
        loss += penalty / 2 * (w @ w)
        if loss > least * (1 + 1e-4):
            w = (w + best) / 2
            continue
        best, least = w, loss
        step = np.linalg.solve(hess + (penalty + 1e-9) * np.eye(width), grad - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-5:
            return w
    return best


def untaught(names: tuple[str, ...]) -> Ranker:
    zero = (0.0,) * len(names)
    return Ranker(names, zero, (1.0,) * len(names), zero, 0.0, 1.0)


def place(good: int, bad: int) -> int:
    """How many training scores lie below the cut."""
    return min(max(bad, 1), good + bad - 1)


def fit(rows: np.ndarray, label: np.ndarray, names: tuple[str, ...], penalty: float = 1e-3, rounds: int = 30) -> Ranker:
    """Bradley-Terry by Newton's method over all pairs of rows that are here: what `learned` does for a table."""
    x, label = np.asarray(rows, float).reshape(-1, len(names)), np.asarray(label)
    good, bad = int((label == 1).sum()), int((label == 0).sum())
    if not good or not bad:
        return untaught(names)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = standard(x, mean, scale)
    w = newton(lambda w: merged(*zip(*(tallied(z[a : a + ROWS], label[a : a + ROWS], w) for a in range(0, len(z), ROWS)))), len(names), penalty, rounds)
    ordered, at = np.sort(z @ w), place(good, bad)
    return Ranker(names, tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), float((ordered[at - 1] + ordered[at]) / 2), 1.0)


def neighbours(values: DataFrame, at: int) -> tuple[float, float]:
    """The at-th smallest value (from 1) of column s, and the one after it. Each round cuts the stretch that holds the first into parts and goes on with one of them."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    left = at
    while low < high:
        part = F.least(F.floor((F.col("s") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        for _, n, a, z in sorted(values.where(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.count("*"), F.min("s"), F.max("s")).collect()):
            if left <= n:
                low, high = a, z
                break
            left -= n
    upto, after = values.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low, low if upto > at else after


def learned(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", prefix: str = "", penalty: float = 1e-3, rounds: int = 30) -> Ranker:
    """The ranker of all labelled rows of folds 1 to 4, and of no other. `described`: the features of each row, stored, their names after `prefix`."""
    names = tuple(features(F.lit("")))
    taught = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    own = described.select(F.col(id_col).alias("doc_id"), *(F.col(prefix + k).alias(k) for k in names))
    rows = materialize(own.join(taught.where(bucket_of("doc_id", 5) != 0), "doc_id").select("label", *names), "quality-taught")
    # rounded, so that the order in which rows are added up doesn't show
    near = lambda x: float(f"{x:.9g}")
    good, n, *moments = rows.agg(F.sum("label"), F.count("*"), *(f(k) for f in (F.avg, F.stddev_pop) for k in names)).first()
    if not good or good == n:
        discard(rows)
        return untaught(names)
    mean, scale = (np.array(list(map(near, x))) for x in (moments[: len(names)], moments[len(names) :]))
    scale = np.maximum(scale, 1e-9)

    def total(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, value = merged([], [])
            for b in batches:
                label, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                for a in range(0, len(label), ROWS):
                    k, v = tallied(standard(np.stack([c[a : a + ROWS] for c in x], axis=1), mean, scale), label[a : a + ROWS], w)
                    key, value = merged([key, k], [value, v])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value)], ["key", "value"])

        sums = rows.mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
        return sums["key"].to_numpy(), sums["value"].to_numpy()

    w = newton(total, len(names), penalty, rounds)
    ranker = Ranker(names, tuple(map(float, mean)), tuple(map(float, scale)), tuple(round(float(x), 6) for x in w), 0.0, 1.0)
    below, above = neighbours(rows.select(ranker.raw({k: F.col(k) for k in names}).alias("s")), place(good, n - good))
    discard(rows)
    return replace(ranker, cut=(below + above) / 2)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of `docs`, whose texts are read once."""
    own = features(F.col("text"))
    described = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", *(c.cast("double").alias(k) for k, c in own.items()))
    described = materialize(described, "quality-features")
    ranker = learned(described, labels.withColumnRenamed(id_col, "doc_id"), label_col=label_col)
    judged = described.select("doc_id", ranker.odds({k: F.col(k) for k in own}).alias("odds"))
    return judged.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), ranker.score("odds").alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the classifier keeps, each judged by its own text. They are written once with their features, so that those are worked out once."""
    own, prefix = features(F.col(text_col)), "_quality_"
    described = materialize(docs.select("*", *(c.cast("double").alias(prefix + k) for k, c in own.items())), "quality-features")
    odds = learned(described, labels, id_col, prefix=prefix).odds({k: F.col(prefix + k) for k in own})
    return described.where(odds >= 0).select(*docs.columns)
