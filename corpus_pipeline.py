"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return docs' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import decontaminate, langid, packing, simhash, substrings
from leadloom.llm.common import materialize
from leadloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be found; lang is filled with it where it is null.

    Null and empty texts and texts without a letter go. When no label is there to learn from, texts
    with a letter stay as they are. Repeated rows and null ids are judged row by row; an empty table
    gives an empty one.
    """
    found = langid.identify(docs, langid.train(docs), langid.UNLEARNED, ("_lang_found", "_lang_score")).where(F.col("_lang_found") != langid.UNKNOWN)
    learned = F.when(F.col("_lang_found") != langid.UNLEARNED, F.col("_lang_found"))
    return found.withColumn("lang", F.coalesce("lang", learned)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest doc_id, null first; ties go to the first row.

    Repeated rows and rows with shared or null ids are rows like all others; texts without a word
    are near-duplicates of each other; an empty table gives an empty one.
    """
    return simhash.without_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that also start earlier; n_chars follows the text.

    Null texts stay null with n_chars null; texts under 100 bytes stay whole; rows with the same
    doc_id and text are one document; an empty table gives an empty one.
    """
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own text shares no passage with the benchmark; null and empty texts share none and stay.

    Repeated rows go or stay together, null ids are no exception; with an empty benchmark all stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4,096 ids: of every row, a null or empty text giving the end id alone; an empty table gives none."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; what each keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
