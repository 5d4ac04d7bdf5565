"""URL filters: host and path rules, and gradient-boosted trees for the urls that no rule fits.

The longest rule that fits a url decides. Urls so decided are the labelled ones: boosted trees learn from their
lexical features (lengths, depth, shares of digits and hyphens, entropy, parameter counts) and from suffix statistics
(the smoothed share of blocked urls with the same last label, last two labels and path head), and judge the rest. The
statistics count all labelled urls, without a bound on their values, and are joined by value; what the trees learn from
leaves out a url's own fold, so that they can't read the label off it. The trees themselves are fitted on a bounded
sample of distinct urls with both kinds in their shares. All of it is built-in expressions and Spark's own trees.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and is judged by the trees;
urls may be very long; repeated rows are judged each, and count once in the sample; without labelled urls of both
kinds the verdict is the one kind there is, or allow; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Distinct labelled urls that the trees are fitted on at most, by a hash of the url, and of each kind at least (if there are so many).
SAMPLE_ROWS, LEAST_ROWS = 20_000, 1_000
#: Folds of the statistics, and the weight of the mean in a smoothed share.
FOLDS, SMOOTH = 5, 5
TREES, TREE_DEPTH = 10, 4


@dataclass(frozen=True)
class Rule:
    """`verdict` (allow or block) for a host with its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting(rules: list[Rule]) -> Column:
    """The longest rule that fits columns host and path, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def features() -> dict[str, Column]:
    """Lexical features of columns url, host and path."""
    u, host, path = F.coalesce(F.col("url").cast("string"), F.lit("")), F.col("host"), F.col("path")
    count = lambda t, chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    marks = "abcdefghijklmnopqrstuvwxyz0123456789-."
    share = [count(host, c) / F.greatest(F.length(host), F.lit(1)) for c in marks]
    entropy = F.lit(0.0)
    for p in share:
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "hyphens": count(host, "-"),
        "digits": count(u, "0123456789") / n,
        "parameters": count(u, "&") + count(u, "?"),
        "equals": count(u, "="),
        "others": count(u, "%#~+@!,;") / n,
        "entropy": entropy,
    }


def values() -> dict[str, Column]:
    """What the suffix statistics are taken by."""
    return {
        "last": F.regexp_extract("host", r"([^.]*)$", 1),
        "two": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1),
        "head": F.regexp_extract("path", r"^(/[^/]*)", 1),
    }


def _with_statistics(rows: DataFrame, known: dict[str, DataFrame], mean: float, leave_out: bool) -> DataFrame:
    """`rows` with a smoothed share of blocked urls for each value; values never labelled have the mean. With `leave_out`, without the counts of a row's own fold."""
    for name, table in known.items():
        rows = rows.join(table, F.col(name) == F.col(f"{name}_value"), "left")
        n, k = (F.aggregate(F.coalesce(f"{name}_{x}", F.array()), F.lit(0).cast("long"), lambda a, b: a + b) for x in "nk")
        if leave_out:
            n, k = n - F.coalesce(F.get(f"{name}_n", F.col("fold")), F.lit(0)), k - F.coalesce(F.get(f"{name}_k", F.col("fold")), F.lit(0))
        rows = rows.withColumn(f"f_{name}", (k + SMOOTH * mean) / (n + SMOOTH)).drop(f"{name}_value", f"{name}_n", f"{name}_k")
    return rows


def judged(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block): a row for each row of `pages`; p_block is null where a rule decides."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    own = own.withColumn("host", host).withColumn("path", path).withColumn("by", fitting(rules))
    label = (F.col("by.verdict") == "block").cast("double").alias("label")
    own = own.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("ruled"), label, F.xxhash64("url").alias("h"), *(c.alias(k) for k, c in values().items()), *(c.alias(f"f_{k}") for k, c in features().items()))
    own = materialize(own.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")), "urls-features")
    labelled = own.where(F.col("ruled").isNotNull())
    # distinct urls, and in how many rows
    single = materialize(labelled.groupBy("h").agg(F.max("label").alias("label"), F.count("*").alias("n")), "urls-distinct")
    totals = {r["label"]: (r["k"], r["n"]) for r in single.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        only = "block" if 1.0 in totals else "allow"
        return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    urls, rows = (sum(t[i] for t in totals.values()) for i in (0, 1))
    mean = totals[1.0][1] / rows
    # at most sample_rows + 2 * LEAST_ROWS hashes
    chosen = None
    for kind, (k, _) in sorted(totals.items()):
        some = single.where(F.col("label") == kind).select("h").orderBy("h").limit(max(LEAST_ROWS, sample_rows * k // urls))
        chosen = some if chosen is None else chosen.unionByName(some)
    known = {}
    for name in values():
        counts = labelled.groupBy(F.col(name).alias(f"{name}_value"), "fold").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("k"))
        by_fold = lambda x: F.array(*(F.coalesce(F.sum(F.when(F.col("fold") == i, F.col(x))), F.lit(0)) for i in range(FOLDS)))
        known[name] = materialize(counts.groupBy(f"{name}_value").agg(by_fold("n").alias(f"{name}_n"), by_fold("k").alias(f"{name}_k")), "urls-statistics")
    taught = labelled.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])
    taught = materialize(_with_statistics(taught, known, mean, True), "urls-sample")
    discard(single)
    inputs = [*(f"f_{k}" for k in features()), *(f"f_{k}" for k in known)]
    gather = VectorAssembler(inputCols=inputs, outputCol="x", handleInvalid="error")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=TREE_DEPTH, seed=11, stepSize=0.3, cacheNodeIds=False).fit(gather.transform(taught).select("h", "x", "label").orderBy("h").select("x", "label").coalesce(2))
    rest = model.transform(gather.transform(_with_statistics(own.where(F.col("ruled").isNull()), known, mean, False)))
    rest = rest.withColumn("p_block", vector_to_array("probability")[1])
    rest = rest.select("page_id", "host", "path", "rule", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow").alias("verdict"), "p_block")
    done = labelled.select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    return done.unionByName(rest)
