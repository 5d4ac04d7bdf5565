"""Quality rules as weak supervision, in built-in column expressions alone.

Each rule looks at one side of a text and votes good or bad or abstains. Texts with the same votes form a pattern;
expectation-maximisation on the counts of the patterns (at most 3 to the power of the number of rules, whatever the
corpus) estimates for both classes how often each rule votes good, votes bad or abstains, and from it every text gets a posterior probability
of being good. A text is kept if its posterior is a half or more, so one failed rule doesn't reject it by itself.

Defined cases: null and empty texts have no words and fail the base rules; texts may be very long; repeated rows are
judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
ROUNDS = 50


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts for each row of `docs`: the base features and what the rules look at."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # one pass keeps the few characters that are counted, the counts are then taken on what is left
    marks = F.regexp_replace("t", r"[^!-`{-~]+", "")
    own = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).withColumns({"w": F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""), "marks": marks, "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("w")
    own = own.withColumn("hw", F.transform("w", lambda w: F.xxhash64(w)))
    # past the end there are nulls, which the hash leaves out: the last windows are shorter and equal to none
    own = own.withColumn("h", F.when(n >= WINDOW, F.transform("hw", lambda _, i: F.xxhash64(*(F.get("hw", i + k) for k in range(WINDOW))))))
    own = own.withColumn("again", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("again")
    begins = F.filter(
        F.transform(F.col("again"), lambda x, k: F.when((x.h == F.col("again")[F.greatest(k - 1, F.lit(0))].h) & (k > 0) | (x.h == F.col("again")[F.least(k + 1, m - 1)].h) & (k < m - 1), x.i)),
        lambda i: i.isNotNull(),
    )
    own = own.withColumn("at", F.sort_array(begins))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), lambda s, i: F.struct((s["sum"] + WINDOW - F.greatest(s.end - i, F.lit(0))).alias("sum"), (i + WINDOW).alias("end")), lambda s: s["sum"])
    # a line counts if it has a word, that is, if it isn't only spaces
    count = lambda others: F.length(F.regexp_replace("marks", others, "")).cast("long")
    return own.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("hw")).cast("long").alias("n_distinct"),
        count(r"[^!?]+").alias("n_bangs"),
        count(r"[A-Z]+").alias("n_marks"),
        count(r"[^A-Z]+").alias("n_capitals"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: -1 bad, 1 good, 0 abstains."""
    c, n = F.col, F.col("n_words")
    never = F.lit(False)
    return {
        "length": _vote(n < 20, n >= 40),
        "symbols": _vote(c("n_symbols") * 5 > n, never),
        "symbol_share": _vote(c("n_symbols") * 20 > c("word_chars"), c("n_symbols") * 100 <= c("word_chars")),
        "marks": _vote(c("n_marks") * 8 > c("word_chars"), c("n_marks") * 16 <= c("word_chars")),
        "repeats": _vote(c("n_repeat_words") * 5 > n, never),
        "lines": _vote(c("n_dup_lines") * 4 > c("n_lines"), never),
        "capitals": _vote(c("n_capitals") * 4 > c("word_chars"), never),
        "bangs": _vote(c("n_bangs") * 4 > n, never),
        "word_length": _vote((c("word_chars") > n * 14) | (c("word_chars") < n * 2), c("word_chars").between(n * 3, n * 10)),
        "distinct": _vote(c("n_distinct") * 5 < n, c("n_distinct") * 3 >= n),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """The prior log-odds of good, and for each rule the log-odds that each vote adds, by expectation-maximisation. It begins with texts that no rule finds bad as good."""
    if not patterns:
        return 0.0, []
    rules = len(patterns[0][0])
    good = [0.1 if min(v) < 0 else 0.6 + 0.3 * sum(v) / rules for v, _ in patterns]
    prior, add = 0.0, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        yes = sum(g * n for g, (_, n) in zip(good, patterns))
        prior, add = math.log((yes + 1) / (total - yes + 1)), []
        for r in range(rules):
            own = {x: [0.5, 0.5] for x in (-1, 0, 1)}
            for g, (v, n) in zip(good, patterns):
                own[v[r]][0] += g * n
                own[v[r]][1] += (1 - g) * n
            odds = {x: math.log(own[x][0] / (yes + 1.5)) - math.log(own[x][1] / (total - yes + 1.5)) for x in own}
            # a rule is taken to be no worse than chance
            add.append({-1: min(odds[-1], 0.0), 0: odds[0], 1: max(odds[1], 0.0)})
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(a[x] for a, x in zip(add, v)))))) for v, _ in patterns]
    return prior, add


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base features, base_failed, posterior, kept): a row for each row of `docs`."""
    rules = votes()
    own = materialize(measures(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in rules.items()}), "rules-votes")
    names = [f"vote_{k}" for k in rules]
    patterns = [(tuple(r[:-1]), r[-1]) for r in own.groupBy(*names).count().orderBy(*names).collect()]
    prior, add = estimate(patterns)
    odds = F.lit(prior)
    for name, a in zip(names, add):
        odds = odds + F.when(F.col(name) == 1, a[1]).when(F.col(name) == -1, a[-1]).otherwise(a[0])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = own.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))
