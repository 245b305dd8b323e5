"""The queries of the corpus operators: whole tables, production parameters, digests of real outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, embed_dedup, katz, langid, lengths, merkle, packing, pii, simhash, suffix
from logloom.llm.common import documents
from logloom.ship import ship

JSON_50K, RANKS_50K, RANKS_MULTI = (public_tokenizers.path(f"byte_bpe_{x}") for x in ("50k.json", "50k.tiktoken", "multi_50k.tiktoken"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(documents(spark, sf_dir), least=400, keep="none", report=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("shared", F.lit(0).cast("long")).alias("n_shared_200"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.edit_report(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("changed").alias("changed_paragraphs"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~F.coalesce(held, F.lit(False))))
    out = langid.predict(docs, model)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), JSON_50K, RANKS_50K)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.score(documents(spark, sf_dir), held)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.token_lengths(documents(spark, sf_dir), JSON_50K, RANKS_50K))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir), tau=4, size=4, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_column(documents(spark, sf_dir), RANKS_MULTI)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Cosines of all pairs of a label in double precision, then the smallest id reachable over the links.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), link AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reached AS (
  SELECT p, q FROM link UNION SELECT r.p, l.q FROM reached r JOIN link l ON r.q = l.p
), degree AS (SELECT p, count(*) AS n FROM link GROUP BY p), least AS (SELECT p, min(q) AS m FROM reached GROUP BY p)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.p LEFT JOIN least l ON e.vec_id = l.p
"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express: the others hash, tokenize or learn in ways it has no words for."""
    return {"op1_embedding_near_dedup": OP1_SQL}
