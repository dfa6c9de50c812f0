"""Live views of the event stream; each works on a static table as well, which is how it is checked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling_counts(events: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    out = _late(events, delay).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    out = _late(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Each key once: a second result for a target changes nothing."""
    return _late(events, delay).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    errors, success = state.get if state.exists else (0, False)
    for f in frames:
        errors += int((f["event_type"] == "error").sum())
        success |= bool((f["event_type"] == "purchase").any())
    state.update((errors, success))
    yield pd.DataFrame([{"user_id": key[0], "n_error": errors, "resolution": "succeeded" if success else "exhausted" if errors >= 3 else "retryable"}])


def live_targets(events: DataFrame) -> DataFrame:
    """What each key's attempts amount to so far, updated as they come in; the state is two values a key."""
    return events.groupBy("user_id").applyInPandasWithState(_fold, "user_id long, n_error long, resolution string", "errors long, success boolean", "update", "NoTimeout")
