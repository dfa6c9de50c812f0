"""Vectors of texts that are encoded once: a table keyed by model and the text's hash, which only grows by what is new.

A run writes new vectors before it reads them back, so one that fails leaves what it had written for the next; a vector that was written
twice is read once. Compacting writes the vectors anew to a folder of its own and then says so in a list of folders, so readers see the one
or the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.text import embed

VECTORS = "model string, digest string, embedding array<float>"
FOLDERS = "folder string, number int"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self) -> tuple[str, int]:
        last = _rows(self.spark, f"{self.path}/folders", FOLDERS).orderBy(F.desc("number"), "folder").first()
        return (last["folder"], last["number"]) if last else ("first", 0)

    def vectors(self) -> DataFrame:
        """``model, digest, embedding``: one vector for each."""
        found = _rows(self.spark, f"{self.path}/{self._folder()[0]}", VECTORS)
        return found.groupBy("model", "digest").agg(F.min("embedding").alias("embedding"))

    def embedded(self, texts: DataFrame, text: str, model: str, encoder: Callable) -> DataFrame:
        """``texts`` with ``embedding``, encoding only texts that the model has no vector of; a null text has a null vector.

        ``encoder`` maps a list of strings to rows of floats and must give a text the same vector each time.
        """
        digest = F.sha2(F.col(text).cast("binary"), 256)
        known = self.vectors().where(F.col("model") == model)
        new = texts.where(F.col(text).isNotNull()).groupBy(digest.alias("digest")).agg(F.min(text).alias("text")).join(known, "digest", "left_anti")
        if new.limit(1).count():
            made = embed(new, encoder).select(F.lit(model).alias("model"), "digest", "embedding")
            made.write.mode("append").parquet(f"{self.path}/{self._folder()[0]}")
        known = self.vectors().where(F.col("model") == model).select(F.col("digest").alias("_digest"), "embedding")
        return texts.join(known, digest == F.col("_digest"), "left").drop("_digest")

    def compact(self) -> None:
        """Write the vectors, each once, to a new folder. Vectors that another run adds meanwhile are encoded again when asked for."""
        folder, number = uuid.uuid4().hex, self._folder()[1] + 1
        self.vectors().write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(folder, number)], FOLDERS).write.mode("append").parquet(f"{self.path}/folders")


def letter_counts(texts: list[str]) -> list[list[float]]:
    """How often each letter from a to z occurs: an encoder that needs no model."""
    return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]
