"""Cleaning a corpus in five stages, each written as Parquet and read again for the next.

Language identification drops documents without a recognised language; SimHash keeps one document of
each near-duplicate group; suffix-array deduplication cuts repeated passages out of the texts; template
decontamination drops documents that contain a benchmark item; BPE encodes and decodes what is left.

Every stage takes rows with nulls in any column, texts of any length, repeated rows and ids, an empty table,
and further columns of any name, which the first four return as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import materialise
from tessera.llm import bpe, decontaminate, language, simhash, suffix_dedup
from tessera.llm.queries import TOKENIZER


#: Words of a shingle, and bits by which near duplicates differ at most: 58 of 64 bits agree, a share of 0.9.
NEAR_WORDS, NEAR_RADIUS = 5, 6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and texts that fit no language; learns from ``lang``.

    Rows are judged one by one by their text alone, so equal texts stay or go together. Where no row has a
    ``lang``, every text with a letter stays.
    """
    return language.keep_recognised(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the smallest doc_id, null ids last.

    Null and wordless texts are one group. Different texts under one id each count for their own group; of
    rows that repeat an id within a group one stays.
    """
    return simhash.keep_first(docs, NEAR_WORDS, NEAR_RADIUS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes and more that a document with a smaller doc_id holds; n_chars follows.

    All rows stay. Null texts stay null, and rows without an id are neither changed nor looked into; rows of
    one id don't change each other. A character goes as a whole if a part of its bytes is cut.
    """
    cut = suffix_dedup.strip_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half or more of a benchmark item's template windows; null and empty texts stay."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text that the ids decode to, for every row; null texts are empty."""
    coded = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL has no code lengths, SimHash components or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, ids and decoded_sha256 of each document that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
