"""A training corpus from raw documents: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import jaccard, langid, packing, pii, suffix
from logloom.llm.common import discard, materialize
from logloom.llm.queries import JSON_50K, RANKS_50K
from logloom.scratch import swept
from logloom.ship import ship

#: Bytes from which a string that repeats is cut from all but its first place.
REPEAT_BYTES = 200
#: Words of a shingle, and the Jaccard similarity of the shingles from which documents are near copies.
SHINGLE, SIMILAR = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows and keeps every document in which it finds a language."""
    ship(spark)
    return langid.identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: SimHash and MinHash candidates, linked from SIMILAR on."""
    ship(spark)
    return jaccard.one_of_each(docs, SIMILAR, SHINGLE, tau=4, seed=42)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated strings; documents of which nothing is left go."""
    ship(spark)
    return suffix.without_repeats(docs, REPEAT_BYTES)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    ship(spark)
    return pii.without_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their ids."""
    ship(spark)
    pieces = packing.pack(docs, JSON_50K, RANKS_50K)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", repeat_removal), ("pii", personal_data), ("packing", packed)]

#: Models, suffix order and tokenizers are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with swept() as kept:
            out = materialize(stage(spark, docs, sf_dir), name)
            kept.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
