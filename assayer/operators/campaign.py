"""Runs, requests and campaigns: assembly of responses, alignment of results, progress, stalls, repairs and audits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("rubric_gen", "rubric_critic", "score_gen", "score_critic")


def ordinals(samples: DataFrame, run: str, created: str, id: str) -> DataFrame:
    """``samples`` with ``sample_ordinal``, from 1 by time and id within its run, and ``trace_ordinal``, from 0 by time, then id."""
    at = F.row_number().over(Window.partitionBy(run).orderBy(created, id))
    return samples.withColumn("sample_ordinal", at).withColumn("trace_ordinal", at - 1)


def last_of_each(rows: DataFrame, key: str, created: str, id: str) -> DataFrame:
    """The newest row of each key, as a map that is filled in order of time ends up with."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(created), F.desc(id)))).where("_at = 1").drop("_at")


def first_of_each(rows: DataFrame, key: str, created: str, id: str) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(created, id))).where("_at = 1").drop("_at")


def assembled(scores: DataFrame, samples: DataFrame, critics: DataFrame, items: DataFrame) -> DataFrame:
    """One row a score: its sample, its target's last critic, and its items in order, with labels and their signature.

    A score without its sample is dropped; one without a critic or items has nulls and an empty list. ``scores`` has ``score_id,
    sample_id, target_id``; ``critics`` ``target_id, created, critic_id, agreement``; ``items`` ``target_id, position, evidence_id, label``.
    """
    ordered = items.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("position", "evidence_id", "label"))).alias("items"))
    critic = last_of_each(critics, "target_id", "created", "critic_id").select("target_id", "agreement")
    out = scores.join(samples, "sample_id").join(critic, "target_id", "left").join(ordered, "target_id", "left")
    ids = F.coalesce(F.transform("items", lambda x: x["evidence_id"]), F.array().cast("array<string>"))
    labels = F.coalesce(F.transform("items", lambda x: x["label"]), F.array().cast("array<string>"))
    return out.withColumns({"bundle_size": F.size(ids), "bundle_label": F.array_join(labels, " | "), "bundle_signature": F.array_join(F.array_sort(ids), "|")}).drop("items")


def exploded_items(responses: DataFrame, ids: str, labels: str, positions: str) -> DataFrame:
    """A row for each evidence of a response; a list that is too short gives an empty label, or the place itself."""
    rows = responses.select("*", F.posexplode(ids).alias("_at", "evidence_id"))
    return rows.withColumns({"evidence_label": F.coalesce(F.get(labels, F.col("_at")), F.lit("")), "position": F.coalesce(F.get(positions, F.col("_at")), F.col("_at"))}).drop("_at", ids, labels, positions)


def evidence_view(level: Column, texts: list[Column], cascade: bool = True) -> Column:
    """The text of the level asked for, 0 the raw one; where it is missing the next lower one, or without ``cascade`` the raw one."""
    out = texts[0]
    for i, text in enumerate(texts[1:], 1):
        lower = [*texts[i::-1]] if cascade else [text, texts[0]]
        out = F.when(level == i, F.coalesce(*lower)).otherwise(out)
    return out


def aligned_results(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The n-th pending request of a key beside the n-th result of that key; ``missing`` where there is none."""
    nth = lambda df, *order: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    r = nth(requests.where("status = 'pending'").select(key, "ts", "request_id"), "ts", "request_id")
    found = nth(results.select(key, "result_id"), "result_id")
    return r.join(found, [key, "nth"], "left").select(key, "nth", "request_id", "result_id", F.col("result_id").isNull().alias("missing"))


def dead_transport(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Pending requests whose batch is gone or has failed."""
    b = batches.select("batch_id", F.col("status").alias("batch_status"))
    rows = requests.where("status = 'pending'").join(b, "batch_id", "left")
    reason = F.when(F.col("batch_status").isNull(), "missing").when(F.col("batch_status") == "error", "error")
    return rows.select("request_id", "batch_id", reason.alias("reason")).where("reason is not null")


#: Statuses of a batch that can take another's place.
LIVE = ("running", "finalizing", "success")


def superseding(batches: DataFrame, live: tuple[str, ...]) -> DataFrame:
    """For each batch the newest other one of its key that is live and has a reference.

    Of a key only its two newest live ones are looked at: the newest, or for that one itself the next.
    """
    newest = batches.where(F.col("status").isin(*live) & (F.coalesce("ref", F.lit("")) != "")).groupBy("key").agg(F.max(F.struct("created", "batch_id")).alias("one"))
    rest = batches.where(F.col("status").isin(*live) & (F.coalesce("ref", F.lit("")) != "")).join(newest, "key").where(F.col("batch_id") != F.col("one.batch_id")).groupBy("key").agg(F.max(F.struct("created", "batch_id")).alias("two"))
    rows = batches.join(newest, "key").join(rest, "key", "left")
    by = F.when(F.col("one.batch_id") != F.col("batch_id"), F.col("one.batch_id")).otherwise(F.col("two.batch_id"))
    return rows.select("key", "batch_id", by.alias("superseded_by")).where("superseded_by is not null")


def completed_samples(targets: DataFrame) -> DataFrame:
    """Per sample: targets, those scored and judged, and whether all are judged. ``targets`` has ``sample_id, scored, judged``."""
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    out = targets.groupBy("sample_id").agg(F.count("*").alias("targets"), n("scored").alias("scored"), n("judged").alias("judged"))
    return out.withColumn("completed", (F.col("targets") > 0) & (F.col("judged") >= F.col("targets")))


def experiment_summary(runs: DataFrame) -> DataFrame:
    """Per experiment: its runs, samples completed over all of them, and whether one fell short or is exhausted."""
    short = (F.col("status") == "completed") & (F.col("completed") < F.col("target"))
    return runs.groupBy("experiment").agg(F.count("*").alias("runs"), F.sum("completed").alias("completed"), F.bool_or(short | (F.col("exhausted") > 0)).alias("has_failures"))


def request_diagnostics(requests: DataFrame) -> DataFrame:
    """Requests of each stage by status: one row a stage, a column a status."""
    stage = F.element_at(F.split("custom_key", ":"), -1)
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return requests.where("status <> 'ignored'").groupBy(stage.alias("stage")).agg(n("pending"), n("success"), n("error"))


def window_outcomes(evidence: DataFrame, levels: list[str]) -> DataFrame:
    """Per window: evidence, and of each level how much is done; an empty text is not done, and a level waits for the one before."""
    done = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    counts = [x for i, c in enumerate(levels) for x in (F.count_if(done(c)).alias(f"{c}_done"), F.count_if(~done(c) & (done(levels[i - 1]) if i else F.lit(True))).alias(f"{c}_pending"))]
    return evidence.groupBy("window_id").agg(F.count("*").alias("evidence"), *counts)


def evidence_status(texts: list[Column]) -> Column:
    """The highest level that is done, as ``l1_done`` and so on; ``scraped`` before the first."""
    out = F.lit("scraped")
    for i, text in enumerate(texts, 1):
        out = F.when(F.coalesce(text != "", F.lit(False)), f"l{i}_done").otherwise(out)
    return out


def workload_families(experiments: DataFrame) -> DataFrame:
    """Experiments by the targets they will have (samples times bundles, rounded up) and their status."""
    total = F.col("samples") * F.ceil(F.col("evidence") / F.col("bundle_size"))
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return experiments.groupBy(total.cast("long").alias("targets")).agg(F.count("*").alias("experiments"), n("completed"), n("running"), n("paused"))


def stage_distribution(runs: DataFrame) -> DataFrame:
    """Runs in each of the four stages, those without any too."""
    every = runs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, place int")
    return every.join(runs.groupBy("stage").agg(F.count("*").alias("runs")), "stage", "left").na.fill(0, ["runs"])


#: Reasons that a campaign recovers from by itself, and those that make its results invalid.
RECOVERABLE = ("pending_requests_on_dead_transport", "pending_request_no_owner", "retryable_no_transport", "scheduler_not_running")
INVALID = ("stage_waiting_on_exhausted_requests", "batch_missing_ref", "finalizing_no_progress")


def campaign_state(experiments: DataFrame, stuck: DataFrame, key: str, pause_after: str | None = None) -> DataFrame:
    """``key, experiments, campaign_state, scientific_validity``: a row a campaign, the first state that holds.

    ``experiments`` has ``present`` (false for a tag that is missing) and of the latest run, null without one, ``run_status, has_failures,
    current_stage, stage_done, target_count``; ``stuck`` has ``reason``. With ``pause_after`` runs that pause there with all targets done
    are complete too.
    """
    run, here = F.col("run_status"), F.col("present")
    done = run == "completed"
    gate = (run == "paused") & (F.col("current_stage") == pause_after) & (F.col("stage_done") == F.col("target_count")) if pause_after else F.lit(False)
    failed = F.coalesce(F.col("has_failures"), F.lit(False)) | F.coalesce(run.isin("error", "canceled"), F.lit(False))
    every = lambda c: F.coalesce(F.bool_and(F.when(here, F.coalesce(c, F.lit(False)))), F.lit(False))
    e = experiments.groupBy(key).agg(F.count_if(here).alias("experiments"), F.bool_or(~here | failed).alias("broken"), F.count_if(here & run.isNotNull()).alias("runs"), every(done).alias("all_done"), every(gate).alias("all_paused"))
    reasons = stuck.groupBy(key).agg(F.bool_or(F.col("reason").isin(*INVALID)).alias("spoilt"), F.bool_and(F.col("reason").isin(*RECOVERABLE)).alias("recoverable"))
    state = (
        F.when(F.col("broken") | F.coalesce("spoilt", F.lit(False)), "scientifically_invalid").when(F.col("runs") == 0, "preflight_clean")
        .when(F.col("all_done") | F.col("all_paused"), "complete").when(F.col("recoverable"), "stalled_recoverable")
        .when(~F.col("recoverable"), "stalled_unknown").otherwise("healthy_progressing")
    )
    out = e.join(reasons, key, "left").withColumn("campaign_state", state)
    sure = F.when(F.col("campaign_state") == "scientifically_invalid", "scientifically_invalid").when(F.col("campaign_state") == "complete", "scientifically_valid").otherwise("scientifically_unknown")
    return out.select(key, "experiments", "campaign_state", sure.alias("scientific_validity"))


def recoverable_stalls(states: DataFrame) -> DataFrame:
    """Processes and stages with targets to try again and nothing under way. A key is process type, process, stage."""
    part = lambda i: F.element_at(F.split("custom_key", ":"), i)
    n = lambda s: F.count_if(F.col("resolution") == s)
    out = states.groupBy(part(2).alias("process"), part(3).alias("stage")).agg(n("retryable").alias("retryable"), n("pending").alias("pending"))
    return out.where("retryable > 0 and pending = 0").select("process", "stage", "retryable")


def retry_candidates(states: DataFrame, attempts: int = 3) -> DataFrame:
    """Targets to try again: without a pending attempt and with attempts left, with the number of the next."""
    return states.where((F.col("resolution") == "retryable") & (F.col("n_pending") == 0) & (F.coalesce("error_attempt", F.lit(0)) < attempts)).select("custom_key", (F.coalesce("error_attempt", F.lit(0)) + 1).alias("next_attempt"))


def unowned(requests: DataFrame) -> DataFrame:
    """Pending requests that no batch has taken."""
    return requests.where("status = 'pending' and batch_id is null").select("request_id")


def stuck_batches(batches: DataFrame, cutoff: str) -> DataFrame:
    """``reason, batch_id`` of batches from before ``cutoff``: under way without a reference, unless another one took their place; or
    finalizing without a poll since."""
    taken = superseding(batches, LIVE).where("superseded_by is not null").select("batch_id")
    lost = batches.where(F.col("status").isin("submitting", "running", "finalizing") & (F.coalesce("ref", F.lit("")) == "") & (F.col("created") <= F.lit(cutoff))).join(taken, "batch_id", "left_anti")
    still = batches.where((F.col("status") == "finalizing") & (F.coalesce("next_poll", "created") <= F.lit(cutoff)))
    return lost.select(F.lit("batch_missing_ref").alias("reason"), "batch_id").unionByName(still.select(F.lit("finalizing_no_progress").alias("reason"), "batch_id"))


def stuck_work(states: DataFrame, dead: DataFrame, stalls: DataFrame, batches: DataFrame, orphans: DataFrame) -> DataFrame:
    """``reason, subject`` of all that keeps work from going on: exhausted targets, requests whose batch is gone or failed, stages with targets to
    try again and nothing under way, batches that stand still, requests that no batch has taken."""
    part = lambda df, reason, subject: df.select(reason.alias("reason"), subject.cast("string").alias("subject"))
    parts = [
        part(states.where("resolution = 'exhausted'"), F.lit("stage_waiting_on_exhausted_requests"), F.col("custom_key")), part(dead, F.lit("pending_requests_on_dead_transport"), F.col("request_id")),
        part(stalls, F.lit("retryable_no_transport"), F.concat_ws(":", "process", "stage")), part(batches, F.col("reason"), F.col("batch_id")), part(orphans, F.lit("pending_request_no_owner"), F.col("request_id")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


#: What mends each reason; exhausted targets and lost references are for a person to look at.
REPAIRS = {"pending_request_no_owner": ("requeue_orphan_request",), "pending_requests_on_dead_transport": ("repair_stage_transport",), "retryable_no_transport": ("requeue_retryable_request",), "finalizing_no_progress": ("release_expired_batch_claim", "nudge_batch_poll_now")}


def repair_plan(stuck: DataFrame, limit: int | None = None) -> DataFrame:
    """Actions for what is stuck, each once, in order of action and subject."""
    actions = F.create_map(*(x for reason, names in REPAIRS.items() for x in (F.lit(reason), F.array(*map(F.lit, names)))))
    plan = stuck.select(F.explode(F.try_element_at(actions, F.col("reason"))).alias("action"), "subject").dropDuplicates(["action", "subject"]).orderBy("action", "subject")
    return plan if limit is None else plan.limit(limit)


def audit(stored: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """Stored counts beside those computed anew, with ``changed`` where they differ; a missing one counts as 0."""
    a, b = stored.select(key, F.col(value).alias("stored")), computed.select(key, F.col(value).alias("computed"))
    out = a.join(b, key, "full_outer").na.fill(0, ["stored", "computed"])
    return out.withColumn("changed", F.col("stored") != F.col("computed"))


def token_budget(items: DataFrame, key: str, text: str, limit: int = 20_000) -> DataFrame:
    """Of each bundle the tokens its texts will take, a quarter of their characters rounded up, and whether they fit."""
    tokens = F.sum(F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")
    return items.groupBy(key).agg(tokens.alias("tokens")).withColumn("fits", F.col("tokens") <= limit)


def valid_windows(windows: DataFrame, start: str, end: str) -> DataFrame:
    """``windows`` with ``valid``: both dates can be read, and the end isn't before the start."""
    a, b = F.try_to_timestamp(F.col(start)), F.try_to_timestamp(F.col(end))
    return windows.withColumn("valid", F.coalesce(b >= a, F.lit(False)))


def route(batchable: Column, n: Column, least: int = 30) -> Column:
    return F.when(~batchable | (n < least), "job").otherwise("batch")


#: A provider's statuses of a batch under way, and of one that failed.
UNDER_WAY = ("validating", "in_progress", "finalizing", "cancelling")
FAILED = ("failed", "expired", "cancelled")


def batch_status(status: Column) -> Column:
    """``status`` and ``error`` of a provider's batch: what is neither complete nor under way is an error, named after the status or its lack."""
    s = F.lower(F.coalesce(status, F.lit("")))
    state = F.when(s == "completed", "completed").when(s.isin(*UNDER_WAY), "running").otherwise("error")
    error = F.when(s.isin(*FAILED), F.concat(F.lit("batch_"), s)).when(s == "", "batch_missing_status").otherwise(F.concat(F.lit("batch_unknown_status:"), s))
    return F.struct(state.alias("status"), F.when(state == "error", error).alias("error"))


def pending_targets(targets: DataFrame, done: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Targets without a result whose requests are neither under way nor exhausted."""
    busy = states.where(F.col("resolution").isin("pending", "exhausted")).select(key)
    return targets.join(done.select(key), key, "left_anti").join(busy, key, "left_anti")


#: What a request can be about.
TARGETS = ("sample", "sample_score_target", "evidence")


def key_parts(key: Column) -> Column:
    """Type, id and stage of a key; null unless the type is known and id and stage aren't empty. Further parts say nothing."""
    part = lambda i: F.get(F.split(key, ":"), F.lit(i))
    sound = part(0).isin(*TARGETS) & (part(1) != "") & (part(2) != "")
    return F.when(sound, F.struct(part(0).alias("type"), part(1).alias("id"), part(2).alias("stage")))


def bounded(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows, each with ``approximate``: whether there were more."""
    page = rows.orderBy(*order).limit(most + 1)
    many = page.agg((F.count("*") > most).alias("approximate"))
    return page.orderBy(*order).limit(most).join(F.broadcast(many))  # one row


def rubric_rows(raw: DataFrame, id: str, stages: str) -> DataFrame:
    """``id, stage_number, criterion_no, label, criterion``: a row a criterion, from stages with their criteria as lists."""
    s = raw.select(id, F.explode(stages).alias("s"))
    return s.select(id, "s.stage_number", "s.label", F.posexplode("s.criteria").alias("at", "criterion")).select(id, "stage_number", (F.col("at") + 1).alias("criterion_no"), "label", "criterion")


def rubric_text(concept: Column, stages: Column) -> Column:
    """A rubric as a reader sees it: its concept, then a line a stage."""
    lines = F.transform(stages, lambda s: F.concat(F.lit("Stage "), s["stage_number"].cast("string"), F.lit(": "), s["label"], F.lit(". "), F.array_join(s["criteria"], "; ")))
    return F.concat_ws("\n", F.concat(F.lit("Concept: "), concept), F.array_join(lines, "\n"))


def truncated(payload: Column, most: int = 1600) -> Column:
    return F.when(F.length(payload) > most, F.concat(F.substring(payload, 1, most), F.lit("…"))).otherwise(payload)
