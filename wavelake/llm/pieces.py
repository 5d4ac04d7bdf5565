"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut where no vocabulary piece can reach across (before a run of the space mark, at line feeds), and only
distinct words are encoded. All words of a call form flat numpy arrays of symbols. In each round the rank of every
neighbouring pair is looked up, the smallest rank of each word is found by a segmented minimum, and the leftmost pairs
of that rank merge in all words at once; then the arrays are compacted, and words without a pair that merges leave.
Where a merged symbol could at once form a better pair, one merge a word and round keeps the order of the
library's queue exactly. Characters outside the vocabulary fall back to bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; texts may be very long; repeated rows
are encoded each; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words that a worker keeps; the store starts anew beyond it, so memory is bounded.
KEPT_WORDS = 400_000
_MODELS: dict[str, "Pieces"] = {}
codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        name = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        ids = {name[i]: i for i in normal}
        if any(sp.is_unused(i) for i in normal) or any(c not in ids for p in ids for c in p):
            raise ValueError("pieces that are unused, or whose characters are no pieces, are not supported")
        self.bytes_of = {int(name[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        order = sorted(normal, key=lambda i: -sp.get_score(i))
        rank = np.zeros(n, np.int64)
        rank[order] = np.arange(len(order))
        pairs = {ids[p[:k]] * n + ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.rank, self.n = rank, n
        #: Whether all leftmost occurrences may merge at once: no pair with this piece outranks it.
        self.safe = np.ones(n, bool)
        for side in (self.keys // n, self.keys % n):
            np.logical_and.at(self.safe, side, rank[self.merged] > rank[side])
        top = max(map(ord, "".join(name)), default=0) + 2
        self.char = np.full(top, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        cut = "" if any("\n" in p for p in ids if len(p) > 1) else r"\n"
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces with the space mark behind other characters are not supported")
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|{cut}" if cut else ""))
        raw = [bytes([int(name[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else name[i].replace(SPACE, " ").encode() for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array(list(map(len, raw)), np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        #: Pieces that print nothing, and pieces whose space mark falls away at the start of a text.
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.spaced = np.array([p.startswith(SPACE) for p in name])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.store, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and their number for each word."""
        points = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
        symbol = np.where(points < len(self.char), self.char[np.minimum(points, len(self.char) - 1)], -1)
        symbol = np.where(symbol < 0, -1 - points, symbol)
        place = np.arange(len(symbol))
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        far = np.int64(1) << 40
        while len(symbol):
            same = (word[1:] == word[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0)
            key = np.where(same, symbol[:-1] * self.n + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            into = np.append(np.where(hit, self.merged[at], -1), -1)
            rank = np.where(into >= 0, self.rank[into], far)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == far
            if over.any():
                ready.append((place[over], word[over], symbol[over]))
            pick = (rank == least) & ~over
            # of touching picks every other one, from the left; where it isn't safe, the leftmost of the word
            begins = pick & ~np.r_[False, pick[:-1]]
            run = np.arange(len(pick)) - np.maximum.accumulate(np.where(begins, np.arange(len(pick)), 0))
            pick &= run % 2 == 0
            risky = pick & ~self.safe[into]
            if risky.any():
                where = np.flatnonzero(risky)
                later = np.r_[False, word[where[1:]] == word[where[:-1]]]
                pick[where[later]] = False
            symbol = np.where(pick, into, symbol)
            keep = ~over & ~np.r_[False, pick[:-1]]
            symbol, word, place = symbol[keep], word[keep], place[keep]
        if not ready:
            return np.zeros(0, np.int32), np.zeros(len(found), np.int64)
        place, word, symbol = (np.concatenate(x) for x in zip(*ready))
        order = np.argsort(place)
        word, symbol = word[order], symbol[order]
        if (symbol < 0).any():
            width = np.ones(len(symbol), np.int64)
            lost = np.flatnonzero(symbol < 0)
            coded = [[self.bytes_of.get(b, self.unknown) for b in chr(-1 - s).encode()] if self.bytes_of else [self.unknown] for s in symbol[lost].tolist()]
            width[lost] = list(map(len, coded))
            begin = np.cumsum(width) - width
            symbol, word = np.repeat(symbol, width), np.repeat(word, width)
            for b, x in zip(begin[lost].tolist(), coded):
                symbol[b : b + len(x)] = x
        return symbol.astype(np.int32), np.bincount(word, minlength=len(found))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number for each text."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        index = self.index
        new = list({w for found in cut for w in found if w not in index})
        if new:
            ids, number = self.merge(new)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.start = np.append(self.start, len(self.store) + np.cumsum(number) - number)
            self.store, self.length = np.append(self.store, ids), np.append(self.length, number)
        words = np.fromiter((index[w] for found in cut for w in found), np.int64, sum(map(len, cut)))
        number = self.length[words]
        ids = _gather(self.store, self.start[words], number)
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        return ids, np.bincount(text, number, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        raw = _gather(self.raw, self.raw_start[ids], self.raw_length[ids]).tobytes()
        real = ids[~self.control[ids]] if self.control[ids[:1]].any() else ids
        return (raw[1:] if len(real) and self.spaced[real[0]] else raw).decode("utf-8", "one_byte")


def _gather(flat: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + number[0]], then the next stretch, and so on."""
    ends = np.cumsum(number)
    return flat[np.repeat(start - ends + number, number) + np.arange(ends[-1] if len(ends) else 0)]


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): for each row of `docs` the ids of the whole text and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                ids, number = own.encode(b.column(1).to_pylist())
                ends = np.r_[0, np.cumsum(number)]
                decoded = [own.decode(ids[i:j]) for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
