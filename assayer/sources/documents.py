"""Tables whose lists and records travel as JSON text: written so, and read back with their types and what was wrong with them.

Text is parsed once, as a variant, and cast without errors. A row is never lost to a bad document: its column is null, and
``decode_errors`` names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

SUFFIX = "_json"
STAGES = "array<struct<stage_number: int, label: string, criteria: array<string>>>"
#: The documents of a response and of a rubric.
RESPONSE = {
    "randomizations": "array<string>", "decoded_scores": "array<int>", "evidence_ids": "array<string>", "evidence_labels": "array<string>",
    "evidence_titles": "array<string>", "evidence_urls": "array<string>", "window_ids": "array<string>", "evidence_positions": "array<int>",
}
RUBRIC = {"stages": STAGES, "label_mapping": "map<string, int>"}
#: Processes that traces are named after, and the events of batches and jobs that are mirrored.
PROCESSES = ("run", "window")
MILESTONES = {
    "batch": ("batch_submitting", "batch_submitted", "batch_finalizing_started", "batch_success", "batch_apply_error"),
    "job": ("job_queued_handler_started", "job_finalized"),
}


def encoded(rows: DataFrame) -> DataFrame:
    """``rows`` as a table of plain values: lists, maps and records as JSON text in columns with ``_json`` after their names, booleans as 0 and 1."""

    def plain(field) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType | MapType | StructType):
            return F.to_json(c, {"ignoreNullFields": "false"}).alias(field.name + SUFFIX)
        return c.cast("int").alias(field.name) if isinstance(field.dataType, BooleanType) else c

    return rows.select(*map(plain, rows.schema.fields))


def _problem(text: Column, kind: str) -> Column:
    """What is wrong with a document that should be of a type: nothing, ``missing``, ``not JSON`` or ``not <type>``."""
    parsed = F.try_parse_json(text)
    value = F.try_variant_get(parsed, "$", kind)
    wrong = value.isNull()
    if kind.startswith("array<"):
        parts = F.try_variant_get(parsed, "$", "array<variant>")
        nulls = F.size(F.filter(parts, lambda v: v.isNull() | F.is_variant_null(v)))
        wrong = wrong | (F.size(F.filter(value, lambda v: v.isNull())) > nulls)
    outer = kind.split("<")[0]
    return F.when(text.isNull(), "missing").when(parsed.isNull(), "not JSON").when(F.is_variant_null(parsed), "missing").when(wrong, f"not {outer}")


def decoded(rows: DataFrame, documents: dict[str, str]) -> DataFrame:
    """``rows`` with each document's text replaced by a column of its type, and ``decode_errors``, a list of ``name: problem``, empty if all is well.

    A document that isn't JSON, is of another type, or is a list with parts of another type has an error; the parts are null.
    """
    text = {name: F.col(name + SUFFIX) for name in documents}
    problems = F.array(*(F.when(_problem(text[n], kind).isNotNull(), F.concat(F.lit(f"{n}: "), _problem(text[n], kind))) for n, kind in documents.items()))
    values = [F.try_variant_get(F.try_parse_json(text[n]), "$", kind).alias(n) for n, kind in documents.items()]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in {n + SUFFIX for n in documents}]
    return rows.select(*kept, *values, F.array_compact(problems).alias("decode_errors"))


def decoded_responses(rows: DataFrame) -> DataFrame:
    """Responses as a study reads them: documents decoded, flags as booleans, with ``bundle_label``, ``bundle_size`` and, where the table has
    none, the bundle's signature (its sorted ids) and a null cluster."""
    out = decoded(rows, RESPONSE)
    out = out.withColumns({c: F.col(c).cast("boolean") for c in ("abstain_enabled", "abstained")})
    out = out.withColumns({"bundle_label": F.array_join("evidence_labels", " | "), "bundle_size": F.when(F.col("evidence_ids").isNotNull(), F.size("evidence_ids"))})
    if "bundle_signature" not in out.columns:
        out = out.withColumn("bundle_signature", F.array_join(F.array_sort("evidence_ids"), "|"))
    return out if "cluster_id" in out.columns else out.withColumn("cluster_id", F.lit(None).cast("string"))


def decoded_rubrics(rows: DataFrame) -> DataFrame:
    return decoded(rows, RUBRIC)


ITEM_KEYS = ("response_id", "experiment_tag", "sample_ordinal", "bundle_signature", "cluster_id", "bundle_size", "abstained")


def response_items(responses: DataFrame) -> DataFrame:
    """A row for each piece of evidence of each decoded response: a label, title, address or window that is missing is empty, a position its place."""
    place = F.col("place")
    part = lambda c: F.coalesce(F.get(c, place), F.lit(""))
    keys = [c for c in ITEM_KEYS if c in responses.columns]
    rows = responses.select(*keys, "evidence_labels", "evidence_titles", "evidence_urls", "window_ids", "evidence_positions", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    return rows.select(
        *keys, "evidence_id", part("evidence_labels").alias("evidence_label"), part("evidence_titles").alias("evidence_title"), part("evidence_urls").alias("evidence_url"),
        part("window_ids").alias("window_id"), F.coalesce(F.get("evidence_positions", place), place).alias("position"),
    )


def process_ref(trace: Column) -> Column:
    """Process type and id of a trace's name; null unless it is a run's or a window's."""
    part = lambda i: F.get(F.split(trace, ":"), F.lit(i))
    return F.when(part(0).isin(*PROCESSES) & (part(1) != ""), F.struct(part(0).alias("process_type"), part(1).alias("process_id")))


def payload(text: Column) -> Column:
    """``kind`` and ``value`` of a payload: JSON without its white space, or where it is none the text as it is; null if empty."""
    parsed = F.try_parse_json(text)
    return F.when(text != "", F.struct(F.when(parsed.isNull(), "text").otherwise("json").alias("kind"), F.coalesce(F.to_json(parsed), text).alias("value")))


def event_envelopes(events: DataFrame, service: str, dataset: str | None = None) -> DataFrame:
    """``events`` (``trace_id, event_id, entity_type, event_name, ts_ms, payload_json``) as they are sent out: with a running number, the
    parsed payload, the process, the service and where to look the trace up.

    The number is the time in microseconds, whose last three digits come from the event's id, so that it is the same each time. ``mirrored``
    tells whether the event is kept with its process: its own events, and milestones of its batches and jobs.
    """
    ref = process_ref(F.col("trace_id"))
    kept = F.col("entity_type") == ref["process_type"]
    for entity, names in MILESTONES.items():
        kept = kept | (F.col("entity_type") == entity) & F.col("event_name").isin(*names)
    place = F.concat(F.lit(f"dataset={dataset} trace_id="), F.col("trace_id")) if dataset else F.lit(None).cast("string")
    body = payload(F.col("payload_json"))
    return events.withColumns({
        "seq": F.col("ts_ms") * 1000 + F.pmod(F.col("event_id"), F.lit(1000)), "payload": body["value"], "payload_kind": body["kind"], "process_type": ref["process_type"], "process_id": ref["process_id"],
        "service": F.lit(service), "external_trace_ref": place, "mirrored": ref.isNotNull() & F.coalesce(kept, F.lit(False)),
    })
