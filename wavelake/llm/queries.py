"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, langid, packing, pieces, pivots, quality, rules, secrets, simhash, urls
from .common import table

#: The rules of query op10, as (verdict, host, path).
URL_RULES = [urls.Rule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.components(table(spark, sf_dir, "embeddings"), 0.9)


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.KINDS))
    return found.select("doc_id", *(count(k) for k in secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pivot_permutation, op2_weak_supervision, op3_simhash, op4_language_crf, op5_quality_ranking, op6_secret_ledger, op7_context_tree, op8_packing, op9_sentencepiece, op10_url_trees)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None of the ten is expressible in SQL as a whole: each holds a learned, hashed or tokenised column. tests/llm compares all of them with brute force."""
    return {}
