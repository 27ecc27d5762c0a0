"""Corpus pipeline: rejects poor documents, keeps one of each near-duplicate group, removes repeated phrases,
masks personal data, packs what is left.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``, whatever other columns they are given. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdread.llm import minhash, packing, phrase_dedup, pii, quality
from crowdread.llm.staging import release, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates of the pipeline: five words, a similarity of 0.8.
WORDS, PERCENT = 5, 80


def documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    All rows of an id go if one of them is rejected. Null and empty texts are scored as empty; rows without doc_id stay.
    """
    scores = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    poor = scores.filter("predicted = 0").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(poor, "doc_id", "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Null and empty texts are copies of nothing and stay, rows without doc_id too. Rows that repeat an id stay or go together.
    """
    copies = minhash.near_duplicates(docs, WORDS, PERCENT).filter("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the phrases that an earlier one has; line breaks are kept where nothing is removed.

    Null texts and rows without doc_id stay as they are. Rows of one id do not judge each other, and each loses words of its own text.
    """
    spans = phrase_dedup.repeated_spans(docs)
    texts, losing = docs.select(*COLUMNS).alias("d"), spans.drop("spans").alias("s")
    touched = texts.join(losing, phrase_dedup.of_row("text"), "left_semi").select(*COLUMNS)
    kept = texts.join(losing, phrase_dedup.of_row("text"), "left_anti").select(*COLUMNS)
    return kept.unionByName(documents(phrase_dedup.remove_words(touched, spans)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts stay null; equal rows are masked alike."""
    return documents(pii.masked(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", drop_poor),
    ("near-duplicate documents", drop_copies),
    ("repeated phrases", drop_phrases),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: Models, sketches and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return docs
