"""A corpus pipeline of five stages: documents that have a language, once each, mixed to target weights and packed.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and further columns of any name, and gives an empty
table for an empty one; each states below what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.common import materialise, scratch
from sessionloom.llm.exact_dedup import deduplicate
from sessionloom.llm.language import with_language
from sessionloom.llm.mixing import mix
from sessionloom.llm.near_dedup import without_near_copies
from sessionloom.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that have a language; null and blank texts, and texts without a letter, have none and go. Repeated rows stay or go alike."""
    return with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, a null one only if there is no other; null texts equal empty ones; of repeated rows one."""
    return deduplicate(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id, a null one only if there is no other; null and blank texts are no copies."""
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of their source takes them, 0 to 3 times; a null source is one of its own; null and blank texts have size 0."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places; a row that is there several times is packed each time; null texts are the end id alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL has no rank-order profiles, MinHash classes or tokenizer: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. What a stage wrote on its way is deleted once its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            made.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
