"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. The ledger is a Parquet table with one row for each blob and
rule version that was scanned, findings included. A run leaves out the blobs that the ledger has for the current rule
version, scans one copy of each of the rest, appends the findings, and joins the ledger's findings back to every path
(id) that holds the blob. A second run over a grown corpus thus scans only what is new, and a new rule version scans
everything once. Copies meet by their text alone: a task passes on each text once, so a text that a third of all rows
share is sent once by each task, and only blobs with findings are joined back.

Besides the base kinds there are tokens whose form is unmistakable (EXTRA).

Defined cases: a null text is the empty blob, without findings; repeated rows and equal texts share one scan and get
equal findings; rows with a null id, and several texts under one id, get the findings of their own text; an empty table
gives an empty result; extra columns of the input are carried by `redacted` and ignored elsewhere.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, sized

RULE_VERSION = "2"
#: Kinds in their order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Shorter runs of hex digits fail their length test anyway, and a run is always taken whole.
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds beyond the base ones: access tokens of code hosts and chats, signed web tokens, private keys.
EXTRA = {
    "hosting": re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})"),
    "chat": re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"),
}
_EXTRA_HINTS = {"hosting": ("gh", "glpat-"), "chat": ("xox",), "jwt": ("eyJ",), "private_key": ("PRIVATE KEY-----",)}
ORDER = {k: i for i, k in enumerate((*KINDS, *EXTRA))}
_HINTS = ("passw", "secret", "token", "api")
_MARK = {"assign": "[SECRET]", "access": "[ACCESS-KEY]", "hex": "[HEX]", "hosting": "[TOKEN]", "chat": "[TOKEN]", "jwt": "[TOKEN]", "private_key": "[PRIVATE-KEY]"}


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for kind, pattern in EXTRA.items():
        if any(h in text for h in _EXTRA_HINTS[kind]):
            spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], _MARK[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [scan(t.as_py()) for t in b.column(1)]
        spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), spans], ["blob", "spans"])


_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def hits(docs: DataFrame, ledger: str | None = None, text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """(blob, spans) of the ledger's blobs that have findings, after the unseen blobs of `docs` were scanned. `ledger`: the folder of the ledger, kept between runs; without one each call begins a new one in the shared folder."""
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/secrets-ledger-{uuid.uuid4().hex}"
    schema = f"blob string, spans {_SPANS}, rule_version string"
    held = docs.select(_text(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    try:
        seen = spark.read.schema(schema).parquet(ledger)
        held = held.join(seen.where(F.col("rule_version") == version).select("blob").hint("shuffle_hash"), "blob", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    single = held.groupBy("blob").agg(F.any_value("text").alias("text"))
    scanned = single.mapInArrow(_scan_batches, f"blob string, spans {_SPANS}").withColumn("rule_version", F.lit(version))
    scanned.write.mode("append").parquet(ledger)
    known = spark.read.schema(schema).parquet(ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0))
    return materialize(known.dropDuplicates(["blob"]).select("blob", "spans"), "secrets-hits")


def findings(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, spans) for each row of `docs`, spans an array of (kind, start, end), empty if there are none."""
    found = hits(docs, ledger, text_col, version)
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(_text(text_col), 256).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with every secret replaced by a mark, `length_col` (if there is one) brought up to date. Rows without findings are as they were."""
    hit = sized(hits(docs, ledger, text_col), 100_000).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            new = [redact(t, [(s["kind"], s["start"], s["end"]) for s in x]) if x and t else t for t, x in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [pa.array(new, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns[:-1])]
            if (size := b.schema.get_field_index(length_col)) >= 0:
                columns[size] = pa.array([len(t) if x and t else n for t, x, n in zip(new, b.column(b.num_columns - 1).to_pylist(), columns[size].to_pylist())], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    # by the row's own text: ids may be null or hold several texts
    named = docs.withColumn("_of", F.sha2(_text(text_col), 256))
    joined = named.join(hit, named._of == hit._blob, "left").select(*(named[c] for c in docs.columns), "_spans")
    return joined.mapInArrow(run, docs.schema)
