"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Stages keep the columns of ``documents``; the last returns the pieces of the sequences. Each works on all its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.decontamination import decontaminate
from assayer.llm.language_id import UNKNOWN, fit_languages, identify
from assayer.llm.line_dedup import remove_repeated_lines
from assayer.llm.near_dedup import near_duplicates
from assayer.llm.packing import pack
from assayer.llm.scratch import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a text go, and those that are in none of the languages of the table: letters at random, encoded data.

    The languages are those of the column ``lang``. Repeated rows are judged alike; if no row has a language, all go.
    """
    told = identify(docs, fit_languages(docs)).where(F.col("lang_pred") != UNKNOWN)
    return told.where(~F.col("strange")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go, and documents that consist of nothing else."""
    out = remove_repeated_lines(docs, count=False)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows that share an id are one document."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [(f.__name__, f) for f in (language_id, line_dedup, near_dedup, decontamination, packing)]

#: SQL can express neither the first stage nor the last; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
