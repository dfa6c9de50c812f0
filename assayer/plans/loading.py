"""Queries of what is read and written: documents as JSON text, event envelopes, the embedding cache, snapshots bound by a contract."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.plans.queries import _query
from assayer.sources import documents
from assayer.sources.checkpoints import shared_folder
from assayer.sources.embeddings import EmbeddingCache, letter_counts
from assayer.sources.fixtures import table
from assayer.sources.snapshots import SnapshotStore

#: Orders as responses: their lines are evidence. A few documents are cut off, of another type, or have a part of another type.
_RESPONSES = """select o_orderkey as response_id, concat('v3_', o_orderstatus) as experiment_tag, o_custkey as sample_ordinal, 1 as abstain_enabled, cast(o_orderkey % 5 = 0 as int) as abstained, '["order", "label"]' as randomizations_json,
 case when o_orderkey % 31 = 0 then '[1, "x"]' when o_orderkey % 5 = 0 then '[]' else concat('[', o_orderkey % 4 + 1, ']') end as decoded_scores_json, ids as evidence_ids_json,
 case when o_orderkey % 37 = 0 then '{{{{"a": 1}}}}' else labels end as evidence_labels_json, '[]' as evidence_titles_json, case when o_orderkey % 41 = 0 then null else '[]' end as evidence_urls_json,
 case when o_orderkey % 43 = 0 then '["w1", ' else '["w1"]' end as window_ids_json, places as evidence_positions_json
 from {orders} join (select l_orderkey, {ids} as ids, {labels} as labels, {places} as places from {lineitem} group by l_orderkey) on l_orderkey = o_orderkey"""
_LISTED = {"ids": "concat('P', cast(l_partkey as varchar(20)))", "labels": "concat('E', cast(l_linenumber as varchar(20)))", "places": "l_linenumber"}


def _response_documents(spark, d):
    listed = {n: f"to_json(transform(array_sort(collect_list(struct(l_linenumber, {e} as x))), s -> s.x))" for n, e in _LISTED.items()}
    return spark.sql(_RESPONSES.format(orders="{orders}", lineitem="{lineitem}", **listed), orders=table(spark, d, "orders"), lineitem=table(spark, d, "lineitem"))


_DECODED = """l as (select l_orderkey as k, list(concat('P', l_partkey) order by l_linenumber, concat('P', l_partkey)) as ids, list(concat('E', l_linenumber) order by l_linenumber) as labels, list(l_linenumber order by l_linenumber) as places from lineitem group by 1),
r as (select o_orderkey as response_id, concat('v3_', o_orderstatus) as experiment_tag, o_custkey as sample_ordinal, o_orderkey % 5 = 0 as abstained, case when o_orderkey % 31 = 0 then [1, null] when o_orderkey % 5 = 0 then [] else [o_orderkey % 4 + 1] end as scores, ids,
 case when o_orderkey % 37 <> 0 then labels end as labels, places, list_filter([case when o_orderkey % 31 = 0 then 'decoded_scores: not array' end, case when o_orderkey % 37 = 0 then 'evidence_labels: not array' end, case when o_orderkey % 41 = 0 then 'evidence_urls: missing' end, case when o_orderkey % 43 = 0 then 'window_ids: not JSON' end], lambda x: x is not null) as errors from orders join l on k = o_orderkey)"""


@_query("p2_decoded_responses", f"""with {_DECODED} select response_id, abstained, coalesce(array_to_string(list_transform(scores, lambda x: coalesce(x::varchar, '-')), ','), '') as scores, array_to_string(labels, ' | ') as bundle_label, len(ids)::int as bundle_size, array_to_string(list_sort(ids), '|') as bundle_signature, array_to_string(errors, '; ') as errors from r""")
def _(spark, d):
    r = documents.decoded_responses(_response_documents(spark, d))
    scores = F.array_join(F.transform("decoded_scores", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return r.select("response_id", "abstained", scores.alias("scores"), "bundle_label", "bundle_size", "bundle_signature", F.array_join("decode_errors", "; ").alias("errors"))


@_query("s14_response_items", f"""with {_DECODED}, u as (select *, unnest(range(0, len(ids))) as place from r) select response_id, experiment_tag, sample_ordinal, len(ids)::int as bundle_size, abstained, ids[place + 1] as evidence_id, coalesce(labels[place + 1], '') as evidence_label, case when place = 0 and response_id % 43 <> 0 then 'w1' else '' end as window_id, places[place + 1]::int as position from u""")
def _(spark, d):
    items = documents.response_items(documents.decoded_responses(_response_documents(spark, d)))
    return items.select("response_id", "experiment_tag", "sample_ordinal", "bundle_size", "abstained", "evidence_id", "evidence_label", "window_id", F.col("position").cast("int").alias("position"))


@_query("p3_s8_rubric_documents", """select p_partkey as rubric_id, 3 as n_stages, p_name as first_label, array_to_string([p_brand, p_type], '; ') as first_criteria, 2 as stage_of_b, '' as errors from part""")
def _(spark, d):
    """Rubrics written as JSON text and read back."""
    stage = lambda i, label, *criteria: F.struct(F.lit(i).alias("stage_number"), label.alias("label"), F.array(*criteria).alias("criteria"))
    stages = F.array(stage(1, F.col("p_name"), F.col("p_brand"), F.col("p_type")), stage(2, F.lit("middle")), stage(3, F.lit('last "one"'), F.lit("é")))
    rubrics = table(spark, d, "part").select(F.col("p_partkey").alias("rubric_id"), stages.alias("stages"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("label_mapping"))
    r = documents.decoded_rubrics(documents.encoded(rubrics))
    first = F.get("stages", F.lit(0))
    return r.select("rubric_id", F.size("stages").alias("n_stages"), first["label"].alias("first_label"), F.array_join(first["criteria"], "; ").alias("first_criteria"), F.col("label_mapping")["b"].alias("stage_of_b"), F.array_join("decode_errors", "; ").alias("errors"))


_EVENTS = """select event_id, case when user_id % 7 = 0 then 'other:1' when user_id % 11 = 0 then 'run:' else concat(case when user_id % 2 = 0 then 'run:' else 'window:' end, cast(user_id as varchar(20))) end as trace_id,
 case event_id % 4 when 0 then 'run' when 1 then 'batch' when 2 then 'job' else 'request' end as entity_type, case event_id % 3 when 0 then 'batch_success' when 1 then 'job_finalized' else event_type end as event_name, {ms} as ts_ms,
 case event_id % 5 when 0 then null when 1 then '' when 2 then 'not json' when 3 then '{{ "a" : 1 }}' else '[1, 2]' end as payload_json from {events}"""


@_query("f23_f38_y21_event_envelopes", f"""with e as ({_EVENTS.format(ms="epoch_us(ts) // 1000", events="events").replace("{{", "{").replace("}}", "}")}), p as (select *, split_part(trace_id, ':', 1) in ('run', 'window') and split_part(trace_id, ':', 2) <> '' as known from e)
select event_id, ts_ms * 1000 + event_id % 1000 as seq, case event_id % 5 when 2 then 'not json' when 3 then '{{"a":1}}' when 4 then '[1,2]' end as payload, case event_id % 5 when 2 then 'text' when 3 then 'json' when 4 then 'json' end as payload_kind,
 case when known then split_part(trace_id, ':', 1) end as process_type, case when known then split_part(trace_id, ':', 2) end as process_id, 'engine' as service, 'dataset=traces trace_id=' || trace_id as external_trace_ref,
 known and (entity_type = split_part(trace_id, ':', 1) or entity_type = 'batch' and event_name = 'batch_success' or entity_type = 'job' and event_name = 'job_finalized') as mirrored from p""")
def _(spark, d):
    e = spark.sql(_EVENTS.replace("{ms}", "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"), events=table(spark, d, "events"))
    out = documents.event_envelopes(e, "engine", "traces")
    return out.select("event_id", "seq", "payload", "payload_kind", "process_type", "process_id", "service", "external_trace_ref", "mirrored")


@_query("s21_cached_embeddings", """select p_partkey, array_to_string(list_transform(range(0, 26), lambda i: (length(p_name) - length(replace(lower(p_name), chr((97 + i)::int), '')))::int), ',') as letters from part""")
def _(spark, d):
    """Letter counts of the parts' names by way of a cache, of which the first half was there before."""
    cache, part = EmbeddingCache(spark, f"{shared_folder(spark)}/assayer-{uuid.uuid4().hex}"), table(spark, d, "part").select("p_partkey", "p_name")
    cache.embedded(part.where("p_partkey % 2 = 0"), "p_name", "letters", letter_counts)
    cache.compact()
    vectors = cache.embedded(part, "p_name", "letters", letter_counts)
    return vectors.select("p_partkey", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("letters"))


@_query("s12_s15_y6_contract_bundle", """select case when l_linestatus = 'F' then 'v3_f' else 'v3_o' end as experiment_tag, 3 as schema_version, count(*) as responses, (select count(*) from part where (p_partkey % 2 = 0) = (case when l_linestatus = 'F' then true else false end)) as rubrics from lineitem group by l_linestatus""")
def _(spark, d):
    """Two studies exported and read back by a contract that names their snapshots and rows."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/assayer-{uuid.uuid4().hex}")
    lines, part = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus"), table(spark, d, "part").select("p_partkey")
    for tag, status, rest in (("v3_f", "F", 0), ("v3_o", "O", 1)):
        store.export(tag, f"run_{tag}", {"responses": lines.where(F.col("l_linestatus") == status), "rubrics": part.where(F.col("p_partkey") % 2 == rest)})
    found = [store.required_run(tag=t) for t in ("v3_f", "v3_o")]
    whole = {n: sum(store.manifest_of(m["snapshot_id"])["tables"][n] for m in found) for n in ("responses", "rubrics")}
    contract = {"snapshot_ids": [m["snapshot_id"] for m in found], "experiment_tags": ["v3_f", "v3_o"], "export_schema_version": 3, "row_counts": whole}
    tables = store.bound(contract, ["responses", "rubrics"])
    count = lambda n: tables[n].groupBy("snapshot_id").agg(F.count("*").alias(n))
    known = store.completed().select("snapshot_id", "experiment_tag", "schema_version")
    return known.join(count("responses"), "snapshot_id").join(count("rubrics"), "snapshot_id").drop("snapshot_id")
