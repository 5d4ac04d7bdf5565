"""Best-fit packing of tokenised documents into sequences, with bounds that certify the number of bins.

Documents become runs of token ids with an end id, and only those longer than a sequence are cut, the first piece
taking the remainder. Pieces are dealt evenly into groups of bounded size, each packed by best-fit decreasing. Lower
bounds by dual feasible functions (the volume, and for each threshold k the classes above L - k, above a half, and
from k to a half) say how few bins a group can have: where best-fit reaches the bound it is certified. As long as the
total is above the bound for all pieces, groups with a gap send the pieces of their unfilled bins, and all groups those
of their emptiest bin, into an exchange, which is dealt anew and packed again, until the total meets that bound, one
group is left, or ROUNDS are over. Every piece carries the certificate: the bins and the bound of what its group closed
with it, and the bins and the bound of the whole.

Defined cases: a null text is empty and becomes the end id alone; repeated rows, equal or null ids are packed as
pieces of their own; an empty table gives an empty result; texts that the fast coder can't take (a million spaces) and
vocabulary files with another normaliser or pre-tokeniser go through the tokenizers library; extra columns of the input
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, END = 2048, 0
#: Pieces of a group, about.
GROUP = 4096
ROUNDS = 8
#: Runs of spaces from this length on are too much for the fast coder's pattern, which tries them again from every end.
LONG_SPACE = 50_000
_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
_CODERS: dict[str, tuple] = {}


def coder(path: str):
    """The byte-level BPE of a tokenizers file, run from the same vocabulary and merges by tiktoken, or None where the file asks for other steps; and the library's own coder. Made once for each worker."""
    if path not in _CODERS:
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spec, own = json.load(open(path, encoding="utf-8")), Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()
        before, fast = spec.get("pre_tokenizer") or {}, None
        if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            text_of = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
            # Fixed rule of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from 256 on.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            text_of |= {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(text_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        _CODERS[path] = fast, own
    return _CODERS[path]


def tokens(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text, the end id last."""
    fast, own = coder(path)
    if not text:
        ids = np.zeros(0, np.uint32)
    elif fast is None or len(text) > LONG_SPACE and _SPACE.search(text):
        ids = np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = fast.encode_to_numpy(text, allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                out: list[list] = [[], [], [], [], [], []]
                for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = tokens(path, text.as_py())
                    first = len(ids) % length or length
                    for n, (a, z) in enumerate(zip([0, *range(first, len(ids), length)], range(first, len(ids) + 1, length))):
                        for column, x in zip(out, (key, n, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z] if with_ids else None)):
                            column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """Bins that any packing of `sizes` needs: the best of the volume and of the dual feasible functions for each threshold."""
    return bound_of(np.bincount(sizes, minlength=length + 1)[: length + 1], length)


def bound_of(count: np.ndarray, length: int = LENGTH) -> int:
    """The same from the number of pieces of each size."""
    number, volume = np.cumsum(count), np.cumsum(count * np.arange(length + 1))
    half = length // 2
    k = np.arange(1, half + 1)
    over = number[length] - number[half]  # of these no two fit together
    large = number[length] - number[length - k]  # next to these nothing of k or more fits
    small = volume[half] - volume[k - 1]
    room = (over - large) * length - (volume[length - k] - volume[half])
    return int(max([-(-int(volume[-1]) // length), *(over + np.maximum(0, -(-(small - room) // length)))]))


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each size."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, n = 0, 0  # bit r: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = length, n, n + 1
        bins[i], offsets[i] = b, length - room
        if room > size:
            open_by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id, offset and the certificate: group_bins and group_bound of what was closed together, total_bins and total_bound of all."""
    own = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    count = np.zeros(length + 1, np.int64)
    for r in own.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    bound, closed = bound_of(count, length), int(count[length])
    one_bin = F.lit(1).cast("long")
    done = [own.where(F.col("length") == length).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one_bin.alias("group_bins"), one_bin.alias("group_bound"))]
    pool, n, groups = own.where(F.col("length") < length), int(count[:length].sum()), 0
    for turn in range(ROUNDS):
        if not n and turn:
            break
        # an eighth of the groups takes their emptiest bins, of `length` pieces each at most, so that tiny pieces meet too
        groups = max(-(-n // (4 * group)), -(-groups // 8)) if turn else max(1, -(-n // group))
        last = groups == 1 or turn == ROUNDS - 1

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("row", ignore_index=True)
            sizes = rows["length"].to_numpy()
            bins, offsets = best_fit_decreasing(sizes, length)
            fill = np.bincount(bins, sizes)
            whole = lower_bound(sizes, length)
            again = (fill < length) if len(fill) > whole else np.arange(len(fill)) == fill.argmin()
            stay = ~again[bins]
            out = rows[columns].assign(sequence_id=rows["row"].groupby(bins).transform("min"), offset=offsets, again=False if last else ~stay)
            # if the exchange takes nothing any more, all of the group stays, else what is not sent on
            return out.assign(all_bins=len(fill), all_bound=whole, group_bins=int((~again).sum()), group_bound=lower_bound(sizes[stay], length))

        dealt = pool.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, again boolean, all_bins long, all_bound long, group_bins long, group_bound long"), "packing-round")
        each = packed.agg(*(F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in (F.col("offset") == 0, (F.col("offset") == 0) & ~F.col("again"), F.col("again")))).first()
        last |= closed + each[0] == bound
        made = [*columns, "sequence_id", "offset"]
        if last:
            done.append(packed.select(*made, F.col("all_bins").alias("group_bins"), F.col("all_bound").alias("group_bound")))
            closed += each[0]
            break
        done.append(packed.where(~F.col("again")).select(*made, "group_bins", "group_bound"))
        closed, n = closed + each[1], each[2]
        pool = packed.where("again").select(*columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("row").withColumns({"total_bins": F.lit(closed).cast("long"), "total_bound": F.lit(bound).cast("long")})


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound, total_bins, total_bound): a row for each piece of each row of `docs`."""
    return pack(pieces(docs, path, id_col, text_col, length), length, group)
