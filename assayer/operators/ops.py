"""Run diagnostics: traces, request attempts and their retries, stage progress, pages and health."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS = 3


#: Classes of errors, in the order in which they are tried, and the words that tell them.
ERRORS = {
    "quota_exhausted": ["quota", "credit"],
    "parse_error": ["parse", "invalid criteria count", "invalid rubric line", "failed to find rubric block", "missing reasoning before rubric block"],
    "timeout": ["timeout", "timed out", "deadline exceeded"],
    "temporary_unavailable": ["try again later", "temporarily unavailable", "couldn't be completed", "could not be completed"],
    "rate_limit": ["rate limit", "429"],
    "orchestrator_error": ["too many bytes read", "convex", "orchestrator"],
    "api_error": ["provider", "api", "openai", "5xx"],
}


def error_class(message: Column) -> Column:
    """The first class whose words the message has, in any case; ``unknown`` without one."""
    m = F.lower(F.coalesce(message, F.lit("")))
    tests = {c: functools.reduce(Column.__or__, (m.contains(w) for w in words)) for c, words in ERRORS.items()}
    tests["parse_error"] |= m.contains("expected ") & m.contains(" stages")
    return F.coalesce(*(F.when(test, c) for c, test in tests.items()), F.lit("unknown"))


def target_states(requests: DataFrame) -> DataFrame:
    """One row per custom key: its attempts, the latest of each kind, and what they amount to.

    Pending while any attempt is; else succeeded if one is, or if its result is stored (``artifact``, where there is such a
    column); else exhausted if the latest error was the third attempt or later, or retryable. Attempts count from 1, as a null does;
    without the column ``attempt_index`` a key's errors are counted.
    """
    at = F.struct("ts", "request_id")
    of = lambda s: F.max_by("request_id", F.when(F.col("status") == s, at))
    n = lambda s: F.count_if(F.col("status") == s)
    out = requests.where("status <> 'ignored'").groupBy("custom_key").agg(
        F.count("*").alias("attempts"), n("pending").alias("n_pending"), n("success").alias("n_success"), n("error").alias("n_error"), F.max_by("request_id", at).alias("latest_request"),
        of("success").alias("success_request"), of("error").alias("error_request"), F.min(F.when(F.col("status") == "pending", F.col("ts"))).alias("oldest_pending"),
        (F.max_by(F.coalesce("attempt_index", F.lit(1)), F.when(F.col("status") == "error", at)) if "attempt_index" in requests.columns else n("error")).alias("error_attempt"),
        F.coalesce(F.bool_or("artifact") if "artifact" in requests.columns else F.lit(False), F.lit(False)).alias("stored"),
    )
    resolution = F.when(F.col("n_pending") > 0, "pending").when((F.col("n_success") > 0) | F.col("stored"), "succeeded").when(F.col("error_attempt") >= ATTEMPTS, "exhausted").otherwise("retryable")
    return out.withColumn("resolution", resolution)


def stage_progress(states: DataFrame) -> DataFrame:
    """Completed, failed and pending targets of each stage, and the stage's status; the stage is the key's last part."""
    stage = F.element_at(F.split("custom_key", ":"), -1)
    n = lambda *s: F.count_if(F.col("resolution").isin(*s))
    out = states.groupBy(stage.alias("stage")).agg(n("succeeded").alias("completed"), n("exhausted").alias("failed"), n("pending", "retryable").alias("pending"), F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("total") == 0, "queued").when(F.col("pending") > 0, "running").otherwise("completed"))


def error_counts(requests: DataFrame) -> DataFrame:
    return requests.where("status = 'error'").groupBy(error_class(F.col("error")).alias("error_class")).agg(F.count("*").alias("n"))


def dead_or_stuck(states: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """Keys pending for longer than the threshold, and exhausted ones, each with its reason."""
    old = states.where((F.col("n_pending") > 0) & (F.unix_timestamp(now) - F.unix_timestamp("oldest_pending") > seconds)).select("custom_key", F.lit("pending_request_no_owner").alias("reason"))
    return old.unionByName(states.where("resolution = 'exhausted'").select("custom_key", F.lit("stage_waiting_on_exhausted_requests").alias("reason")))


def trace_stages(events: DataFrame) -> DataFrame:
    """Of each trace and event name: first and last time, milliseconds between, and events."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    ms = F.floor(micros / 1000)
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), (F.max(ms) - F.min(ms)).alias("duration_ms"))


def trace_terminals(events: DataFrame, terminal: tuple[str, ...] = ("error",)) -> DataFrame:
    """Of each trace: events, the first terminal one, those after it, and repeated sequence numbers.

    Traces are grouped, not sorted in a window: the first terminal event is joined back.
    """
    end = F.min(F.when(F.col("event_type").isin(*terminal), F.col("event_id")))
    per = events.groupBy("user_id").agg(F.count("*").alias("n"), end.alias("first_terminal"), (F.count("event_id") - F.countDistinct("event_id")).alias("repeated"))
    after = events.join(per.select("user_id", "first_terminal"), "user_id").where("event_id > first_terminal").groupBy("user_id").agg(F.count("*").alias("after_terminal"))
    return per.join(after, "user_id", "left").na.fill(0, ["after_terminal"])


def last_events(events: DataFrame, keep: int = 32) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events.withColumn("at", F.row_number().over(newest)).where(F.col("at") <= keep)


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The ``size`` rows that follow a key, and whether more come: one more row than asked for tells."""
    page = rows.where(F.col(key) > after).orderBy(key).limit(size + 1)
    w = Window.orderBy(key)  # size + 1 rows
    return page.withColumn("at", F.row_number().over(w)).withColumn("more", F.count("*").over(Window.partitionBy(F.lit(0))) > size).where(F.col("at") <= size)


def offset_page(rows: DataFrame, order: list[str], offset: int, limit: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, 250))


def latest_run(runs: DataFrame, experiment: str, created: str, run: str, status: str) -> DataFrame:
    """Of each experiment: its newest run, the run's status, and counts by status."""
    at = F.struct(created, run)
    return runs.groupBy(experiment).agg(F.max_by(run, at).alias("latest_run"), F.max_by(status, at).alias("latest_status"), F.count("*").alias("runs"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("completed", "running", "paused")))
