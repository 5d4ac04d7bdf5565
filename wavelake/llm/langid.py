"""Language identification of words by a linear-chain conditional random field.

Every word of a text is labelled with one of the learned languages. Emission features of a word are its character
2- to 4-grams, taken over the word between a start and an end mark (those with a mark are the affixes), and its entry
in a lexicon of words seen often in training, all hashed into fixed weight tables. Transitions between neighbouring
words are learned too, from sequences that join segments of several documents, so that switches of language inside a
text are known. Training maximises the conditional likelihood (AdaGrad); prediction runs forward-backward over the
whole text and averages the posteriors of the words that have letters.

Defined cases: null texts and texts without a letter are `und` with score 0; repeated rows are predicted each; null
lang teaches nothing; without any labelled text every prediction is `und`; an empty table gives an empty result; extra
columns are carried by `filtered` and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, bucket_of, words

#: The fit takes this many labelled documents at most for each language, and of all about SAMPLE_ALL (but LEAST_DOCS of each language at least), and from each a run of words at a hashed place.
SAMPLE_DOCS, SAMPLE_ALL, LEAST_DOCS, SAMPLE_WORDS = 1_000, 64_000, 50, 80
SLOTS = 1 << 17
#: Words that are decoded together.
CHUNK_WORDS = 150_000
#: Positions whose expected moves are worked out at once, in training.
CHUNK_MOVES = 20_000
#: A document of the pipeline has no clear language if its words are surer than this of none, on average. A text of several languages with clear words stays.
LEAST_SURE = 0.5


def _points(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked words in one array, and where each word begins."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 2
    return flat, np.cumsum(lengths) - lengths


def _grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all words (flat), and the word of each."""
    flat, starts = _points(found)
    owner = np.repeat(np.arange(len(found)), np.diff(np.r_[starts, len(flat)]))
    slots, owners, h = [], [], flat
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(1000003) + flat[n - 1 :] if len(h) else h
        same = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
        x = h[same] * np.uint64(0x9E3779B97F4A7C15)
        slots.append((x >> np.uint64(47)).astype(np.int64))
        owners.append(owner[: len(h)][same])
    return np.concatenate(slots), np.concatenate(owners)


class Crf:
    """Weights of a trained chain; `languages` in order."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.grams, self.known, self.moves = np.zeros((SLOTS, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k))

    def emissions(self, found: list[str]) -> np.ndarray:
        slots, owner = _grams(found)
        out = np.stack([np.bincount(owner, self.grams[slots, j], len(found)) for j in range(len(self.languages))], axis=1)
        return out + self.known[np.fromiter((self.lexicon.get(w, 0) for w in found), np.int64, len(found))]

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each position (flat, sequence after sequence, lengths in falling order) and, if asked for, the expected moves."""
        k, start = scores.shape[1], np.cumsum(lengths) - lengths
        local = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
        move = np.exp(self.moves - self.moves.max())
        fore, back = np.empty_like(local), np.ones_like(local)
        active = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")  # sequences longer than t
        for t, m in enumerate(active):
            at = start[:m] + t
            a = local[at] if t == 0 else (fore[at - 1] @ move) * local[at]
            fore[at] = a / a.sum(1, keepdims=True)
        for t in range(len(active) - 1, 0, -1):
            at = start[: active[t]] + t
            b = (back[at] * local[at]) @ move.T
            back[at - 1] = b / b.sum(1, keepdims=True)
        post = fore * back
        post /= post.sum(1, keepdims=True)
        total = np.zeros((k, k))
        inner = np.ones(len(scores), bool)
        inner[start] = False
        at = np.flatnonzero(inner) if moves else np.zeros(0, np.int64)
        for part in (at[i : i + CHUNK_MOVES] for i in range(0, len(at), CHUNK_MOVES)):
            pair = fore[part - 1][:, :, None] * move[None] * (local[part] * back[part])[:, None, :]
            total += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        return post, total

    def train(self, sequences: list[list[tuple[str, int]]], epochs: int = 4, batch: int = 64, rate: float = 0.2, seed: int = 5) -> Crf:
        pick, k = np.random.default_rng(seed), len(self.languages)
        g2, k2, m2 = np.full_like(self.grams, 1e-6), np.full_like(self.known, 1e-6), np.full((k, k), 1e-6)
        for _ in range(epochs):
            order = pick.permutation(len(sequences))
            for at in range(0, len(order), batch):
                part = sorted((sequences[i] for i in order[at : at + batch]), key=len, reverse=True)
                lengths = np.array([len(s) for s in part])
                flat = [w for s in part for w, _ in s]
                gold = np.array([y for s in part for _, y in s])
                code, found = pd.factorize(np.array(flat, object))
                found = list(found)
                slots, owner = _grams(found)
                entry = np.fromiter((self.lexicon.get(w, 0) for w in found), np.int64, len(found))
                post, moved = self.posteriors(self.emissions(found)[code], lengths)
                off = -post
                off[np.arange(len(gold)), gold] += 1
                by_word = np.stack([np.bincount(code, off[:, j], len(found)) for j in range(k)], axis=1) / len(part)
                want = np.zeros((k, k))
                inner = np.ones(len(gold), bool)
                inner[np.cumsum(lengths) - lengths] = False
                np.add.at(want, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
                for weights, past, index, grad in ((self.grams, g2, slots, by_word[owner]), (self.known, k2, entry, by_word)):
                    use, where = np.unique(index, return_inverse=True)
                    g = np.stack([np.bincount(where, grad[:, j], len(use)) for j in range(k)], axis=1) - 1e-5 * weights[use]
                    past[use] += g * g
                    weights[use] += rate * g / np.sqrt(past[use])
                g = (want - moved) / len(part) - 1e-3 * self.moves
                m2 += g * g
                self.moves += rate * g / np.sqrt(m2)
        return self


def learn(rows: list[tuple[str, list[str]]], seed: int = 3) -> Crf | None:
    """A chain from (language, words) segments; None without any."""
    rows = [(lang, [w.lower() for w in found]) for lang, found in rows if found]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    counts = pd.Series([w for _, found in rows for w in found]).value_counts()
    crf = Crf(languages, {w: i for i, w in enumerate(sorted(counts[counts >= 3].index), 1)})
    pick, code = np.random.default_rng(seed), {x: i for i, x in enumerate(languages)}
    segments = [[(w, code[lang]) for w in found] for lang, found in rows]
    joined = []
    for s in segments:
        other = segments[pick.integers(len(segments))]
        a, b = sorted(pick.integers(0, len(other) + 1, 2))
        cut = pick.integers(len(s) + 1)
        joined.append(s[:cut] + other[a:b] + s[cut:] if pick.random() < 0.3 else s)
    return crf.train(joined)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS, length: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """Labelled segments of folds 1 to 4: of each language the documents that a hash of the id puts first, from one count and one scan of the texts."""
    own = docs.where((bucket_of(id_col, 5) != 0) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    totals = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not totals:
        return []
    per = min(per_language, max(LEAST_DOCS, SAMPLE_ALL // len(totals)))
    # a uniform share by the hash, a little above what is needed
    share = F.create_map(*(x for lang, n in sorted(totals.items()) for x in (F.lit(lang), F.lit(1_000_000 if n <= 4 * per else int(1_000_000 * 2 * per / n) + 1))))
    some = own.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    found = F.expr(f"regexp_extract_all(text, '{WORD_JAVA.replace(chr(92), chr(92) * 2)}', 0)")
    some = some.withColumn("w", found).withColumn("at", F.pmod(F.xxhash64("h"), F.greatest(F.size("w") - length, F.lit(0)) + 1).cast("int") + 1)
    some = some.select("lang", "h", "id", F.slice("w", F.col("at"), length).alias("part"))
    # a language has about 4 * per rows at most here
    first = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("place") <= per)
    return [(r.lang, r.part) for r in sorted(first.select("lang", "h", "id", "part").collect(), key=lambda r: (r.lang, r.h, r.id))]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def tag(crf: Crf, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the mean posterior of each language over the words with letters (zeros: none has), the number of switches between neighbouring words' labels, and the mean of the words' largest posteriors."""
    k = len(crf.languages)
    share, switches, sure = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    split = [words(t.lower()) if t else [] for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    most = max(1, min(CHUNK_WORDS, 8 * CHUNK_WORDS // k))
    while len(order):
        m = max(1, int(np.searchsorted(np.cumsum(lengths[order]), most)))
        own, order = order[:m], order[m:]
        code, found = pd.factorize(np.array([w for i in own for w in split[i]], object))
        found = list(found)
        lettered = np.fromiter(map(_has_letter, found), bool, len(found))[code]
        post, _ = crf.posteriors(crf.emissions(found)[code], lengths[own], moves=False)
        owner = np.repeat(np.arange(m), lengths[own])
        post *= lettered[:, None]
        n = np.maximum(np.bincount(owner, lettered, m), 1)
        share[own] = np.stack([np.bincount(owner, post[:, j], m) for j in range(k)], axis=1) / n[:, None]
        sure[own] = np.bincount(owner, post.max(1), m) / n
        best, of = post[lettered].argmax(1), owner[lettered]
        switches[own] = np.bincount(of[1:][(best[1:] != best[:-1]) & (of[1:] == of[:-1])], minlength=m) if len(of) else 0
    return share, switches, sure


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_switches, sure): a row for each row of `docs`."""
    crf = docs.sparkSession.sparkContext.broadcast(learn(sample(docs, id_col, text_col, lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                model = crf.value
                if model is None:
                    lang, score, moves, sure = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                else:
                    share, moves, sure = tag(model, b.column(1).to_pylist())
                    best, score = share.argmax(1), np.minimum(share.max(1), 1.0)
                    lang = [model.languages[i] if s > 0 else "und" for i, s in zip(best, score)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(moves), pa.array(sure)], ["doc_id", "lang_pred", "score", "n_switches", "sure"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long, sure double")
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_switches", "sure")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SURE) -> DataFrame:
    """The rows of `docs` whose text has letters and words that are sure of their language (`least` or more on average), each row judged by its own text; without any labelled text, all that have letters."""
    crf = docs.sparkSession.sparkContext.broadcast(learn(sample(docs, id_col, text_col, lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                texts, model = b.column(at).to_pylist(), crf.value
                keep = [_has_letter(t or "") for t in texts] if model is None else (lambda share, _, sure: (share.max(1) > 0) & (sure >= least))(*tag(model, texts))
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
