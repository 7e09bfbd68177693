"""From raw documents to token ids, in five stages.

Each stage takes what the one before it kept, as a table with the columns of `documents`, and does its
whole job in one call; the last one adds the ids. `run` applies them one after the other;
between them tables may be written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.byte_bpe import encode_texts
from batchloom.llm.decontaminate import without_contaminated
from batchloom.llm.language_id import UNKNOWN, predict_language
from batchloom.llm.near_dedup import keep_one
from batchloom.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter, or no clear answer. A missing lang is filled in."""
    judged = predict_language(docs).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one(docs, width=5).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that are found twice are cut out; documents stay."""
    kept = remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return without_contaminated(docs, items).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text as decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_texts(docs, path, decode=True)
    return coded.select(
        "doc_id",
        F.col("decoded").cast("string").alias("text"),
        "lang",
        "source",
        "n_chars",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: The languages are those of a trained model and the ids those of a vocabulary file: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
