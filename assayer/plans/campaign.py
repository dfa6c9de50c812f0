"""Queries of runs, requests and campaigns, registered with those of ``plans.queries``.

The star schema stands in for the study's tables: orders for samples, their lines for score targets, customers for experiments
and their suppliers for batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import bundles, campaign, ops, text
from assayer.plans.queries import _Q, _query
from assayer.sources.fixtures import requests, table

_STATES = """g as (select custom_key, count(*) filter (status = 'pending') as n_pending, count(*) filter (status = 'success') as n_success,
 max_by(coalesce(attempt_index, 1), {'a': ts, 'b': request_id}) filter (status = 'error') as error_attempt from r where status <> 'ignored' group by 1),
s as (select *, case when n_pending > 0 then 'pending' when n_success > 0 then 'succeeded' when error_attempt >= 3 then 'exhausted' else 'retryable' end as resolution from g)"""


def _states(spark, d):
    return ops.target_states(requests(spark, d))


@_query("w1_w2_sample_ordinals", "select o_orderkey, cast(row_number() over w as int) as sample_ordinal, cast(row_number() over w - 1 as int) as trace_ordinal from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def _(spark, d):
    return campaign.ordinals(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "sample_ordinal", "trace_ordinal")


@_query("j3_last_of_each", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as pos from orders) where pos = 1")
def _(spark, d):
    return campaign.last_of_each(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@_query("j4_first_of_each", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders) where pos = 1")
def _(spark, d):
    return campaign.first_of_each(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@_query("j1_j2_f15_assembled_responses", """with sc as (select l_orderkey * 10 + l_linenumber as score_id, l_orderkey as sample_id, l_partkey as target_id from lineitem where l_returnflag <> 'N'),
cr as (select target_id, agreement from (select l_partkey as target_id, l_discount as agreement, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey * 10 + l_linenumber desc) as pos from lineitem where l_linestatus = 'F') where pos = 1),
it as (select p_partkey as target_id, list(p_brand order by pos) as labels, list(concat('e', pos, '-', p_partkey) order by concat('e', pos, '-', p_partkey)) as ids from (select p_partkey, p_brand, unnest(range(0, p_size % 4)) as pos from part) group by 1)
select score_id, sc.sample_id, target_id, o_orderstatus as status, (round(cast(agreement as double), 9) + 0.0) as agreement, cast(coalesce(len(ids), 0) as int) as bundle_size, coalesce(array_to_string(labels, ' | '), '') as bundle_label, coalesce(array_to_string(ids, '|'), '') as bundle_signature
from sc join orders on o_orderkey = sample_id left join cr using (target_id) left join it using (target_id)""")
def _(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    scores = line.where("l_returnflag <> 'N'").select(number.alias("score_id"), F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("target_id"))
    critics = line.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("target_id"), F.col("l_shipdate").alias("created"), number.alias("critic_id"), F.col("l_discount").alias("agreement"))
    places = part.where("p_size % 4 > 0").select("p_partkey", "p_brand", F.explode(F.sequence(F.lit(0), F.col("p_size") % 4 - 1)).alias("position"))
    items = places.select(F.col("p_partkey").alias("target_id"), "position", F.concat(F.lit("e"), F.col("position").cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("evidence_id"), F.col("p_brand").alias("label"))
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("status"))
    return campaign.assembled(scores, samples, critics, items)


@_query("p4_exploded_items", "select conv_id, pos as \"position\", w as evidence_id, case when pos < 3 then concat('#', w) else '' end as evidence_label from (select conv_id, unnest(ws) as w, cast(unnest(range(0, len(ws))) as int) as pos from (select conv_id, string_split(text, ' ') as ws from conversations where turn = 0 and text is not null))")
def _(spark, d):
    c = table(spark, d, "conversations").where("turn = 0 and text is not null").select("conv_id", F.split("text", " ").alias("ids"))
    c = c.withColumn("labels", F.transform(F.slice("ids", 1, 3), lambda x: F.concat(F.lit("#"), x))).withColumn("places", F.array().cast("array<int>"))
    return campaign.exploded_items(c, "ids", "labels", "places")


@_query("p6_p7_evidence_views", """with e as (select doc_id, doc_id % 4 as level, text as t0, case when doc_id % 3 > 0 then lang end as t1, case when doc_id % 5 > 1 then source end as t2, case when doc_id % 7 = 0 then 'l3' end as t3 from documents)
select doc_id, sha256(coalesce(case level when 3 then coalesce(t3, t2, t1, t0) when 2 then coalesce(t2, t1, t0) when 1 then coalesce(t1, t0) else t0 end, '')) as cascade, sha256(coalesce(case level when 3 then coalesce(t3, t0) when 2 then coalesce(t2, t0) when 1 then coalesce(t1, t0) else t0 end, '')) as flat from e""")
def _(spark, d):
    k = F.col("doc_id")
    texts = [F.col("text"), F.when(k % 3 > 0, F.col("lang")), F.when(k % 5 > 1, F.col("source")), F.when(k % 7 == 0, "l3")]
    sha = lambda cascade: F.sha2(F.coalesce(campaign.evidence_view(k % 4, texts, cascade), F.lit("")).cast("binary"), 256)
    return table(spark, d, "documents").select("doc_id", sha(True).alias("cascade"), sha(False).alias("flat"))


@_query("j15_aligned_results", f"""{_Q}, p as (select custom_key, request_id, cast(row_number() over (partition by custom_key order by ts, request_id) as int) as nth from r where status = 'pending'), q as (select custom_key, request_id as result_id, row_number() over (partition by custom_key order by request_id) as nth from r where status = 'success')
select p.custom_key, p.nth, p.request_id, result_id, result_id is null as missing from p left join q on p.custom_key = q.custom_key and p.nth = q.nth""")
def _(spark, d):
    r = requests(spark, d)
    return campaign.aligned_results(r, r.where("status = 'success'").select("custom_key", F.col("request_id").alias("result_id")), "custom_key")


_BATCHES = "select o_orderkey as batch_id, o_custkey as key, o_orderdate as created, case o_orderstatus when 'F' then 'error' when 'O' then 'running' else 'queued' end as status, case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else 'ref' end as ref from {orders}"


def _batches(spark, d):
    return spark.sql(_BATCHES, orders=table(spark, d, "orders"))


@_query("j13_dead_transport", f"{_Q}, b as ({_BATCHES.format(orders='orders')}), p as (select request_id, request_id * 7 % 30000 as batch_id from r where status = 'pending') select request_id, p.batch_id, case when b.batch_id is null then 'missing' else 'error' end as reason from p left join b using (batch_id) where b.batch_id is null or b.status = 'error'")
def _(spark, d):
    return campaign.dead_transport(requests(spark, d).withColumn("batch_id", F.col("request_id") * 7 % 30000), _batches(spark, d))


@_query("j14_superseding_batches", f"with b as ({_BATCHES.format(orders='orders')}) select a.key, a.batch_id, max_by(o.batch_id, {{'a': o.created, 'b': o.batch_id}}) as superseded_by from b a join b o on a.key = o.key and a.batch_id <> o.batch_id where o.status in ('running', 'finalizing', 'success') and coalesce(o.ref, '') <> '' group by 1, 2")
def _(spark, d):
    return campaign.superseding(_batches(spark, d), campaign.LIVE)


_TARGETS = "select l_orderkey as sample_id, l_linestatus = 'F' as scored, l_linestatus = 'F' and l_returnflag <> 'N' as judged from {lineitem}"
_DONE = "t as (" + _TARGETS.format(lineitem="lineitem") + "), c as (select sample_id, count(*) as targets, count(*) filter (scored) as scored, count(*) filter (judged) as judged, count(*) > 0 and count(*) filter (judged) >= count(*) as completed from t group by 1)"


@_query("a25_a26_completed_samples", f"with {_DONE} select * from c")
def _(spark, d):
    return campaign.completed_samples(spark.sql(_TARGETS, lineitem=table(spark, d, "lineitem")))


@_query("a27_a29_a30_experiment_summary", f"with {_DONE}, u as (select c_nationkey as experiment, case when o_orderstatus = 'F' then 'completed' else 'running' end as status, coalesce(judged, 0) as completed, 2 as target, cast(o_custkey % 50 = 0 as int) as exhausted from orders join customer on o_custkey = c_custkey left join c on sample_id = o_orderkey) select experiment, count(*) as runs, cast(sum(completed) as bigint) as completed, bool_or((status = 'completed' and completed < target) or exhausted > 0) as has_failures from u group by 1")
def _(spark, d):
    done = campaign.completed_samples(spark.sql(_TARGETS, lineitem=table(spark, d, "lineitem")))
    runs = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(done.select("sample_id", "judged"), F.col("sample_id") == F.col("o_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    return campaign.experiment_summary(runs.select(F.col("c_nationkey").alias("experiment"), status.alias("status"), F.coalesce("judged", F.lit(0)).alias("completed"), F.lit(2).alias("target"), (F.col("o_custkey") % 50 == 0).cast("int").alias("exhausted")))


@_query("a32_request_diagnostics", f"{_Q} select split_part(custom_key, ':', 3) as stage, count(*) filter (status = 'pending') as n_pending, count(*) filter (status = 'success') as n_success, count(*) filter (status = 'error') as n_error from r where status <> 'ignored' group by 1")
def _(spark, d):
    return campaign.request_diagnostics(requests(spark, d))


@_query("a33_a34_window_outcomes", "select source as window_id, count(*) as evidence, count(*) filter (a <> '') as l1_done, count(*) filter (not coalesce(a <> '', false)) as l1_pending, count(*) filter (b <> '') as l2_done, count(*) filter (not coalesce(b <> '', false) and coalesce(a <> '', false)) as l2_pending from (select source, text as a, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then lang end as b from documents) group by 1")
def _(spark, d):
    k = F.col("doc_id") % 3
    e = table(spark, d, "documents").select(F.col("source").alias("window_id"), F.col("text").alias("l1"), F.when(k == 0, "").when(k == 1, F.col("lang")).alias("l2"))
    return campaign.window_outcomes(e, ["l1", "l2"])


@_query("p15_evidence_status", "select doc_id, case when doc_id % 5 = 0 then 'l2_done' when coalesce(text <> '', false) then 'l1_done' else 'scraped' end as status from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", campaign.evidence_status([F.col("text"), F.when(F.col("doc_id") % 5 == 0, "x")]).alias("status"))


@_query("a35_workload_families", "select cast((c_nationkey % 3 + 1) * ceil((c_custkey % 40) / 5.0) as bigint) as targets, count(*) as experiments, count(*) filter (c_mktsegment = 'MACHINERY') as n_completed, count(*) filter (c_mktsegment = 'HOUSEHOLD') as n_running, count(*) filter (c_mktsegment not in ('MACHINERY', 'HOUSEHOLD')) as n_paused from customer group by 1")
def _(spark, d):
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "completed").when(F.col("c_mktsegment") == "HOUSEHOLD", "running").otherwise("paused")
    return campaign.workload_families(table(spark, d, "customer").select((F.col("c_nationkey") % 3 + 1).alias("samples"), (F.col("c_custkey") % 40).alias("evidence"), F.lit(5).alias("bundle_size"), status.alias("status")))


@_query("a36_y24_stage_distribution", "select s as stage, cast(place as int) as place, coalesce(runs, 0) as runs from (select unnest(['rubric_gen', 'rubric_critic', 'score_gen', 'score_critic']) as s, unnest(range(0, 4)) as place) left join (select case o_orderstatus when 'F' then 'score_critic' when 'O' then 'rubric_gen' else 'score_gen' end as x, count(*) as runs from orders group by 1) on x = s")
def _(spark, d):
    s = F.col("o_orderstatus")
    return campaign.stage_distribution(table(spark, d, "orders").select(F.when(s == "F", "score_critic").when(s == "O", "rubric_gen").otherwise("score_gen").alias("stage")))


_RUN_ROWS = """select c_custkey % 40 as campaign, case when c_custkey % 40 < 36 or c_custkey % 3 > 0 then true else false end as present, case c_custkey % 40 % 6 when 0 then null when 1 then 'completed' when 2 then 'paused' when 3 then 'running' when 4 then case when c_custkey % 7 = 0 then 'error' else 'completed' end else 'running' end as run_status,
 c_custkey % 40 = 9 and c_acctbal < 0 as has_failures, case when c_custkey % 40 = 2 then 'score_gen' else 'score_critic' end as current_stage, 3 as stage_done, case when c_custkey % 40 = 14 then 4 else 3 end as target_count from {customer}"""
_STUCK_ROWS = """select c_custkey % 40 as campaign, case c_custkey % 40 when 3 then 'retryable_no_transport' when 21 then case when c_custkey % 2 = 0 then 'scheduler_not_running' else 'odd' end when 27 then 'batch_missing_ref' when 33 then 'pending_request_no_owner' else 'scheduler_not_running' end as reason from {customer} where c_custkey % 40 in (3, 21, 27, 33)"""


@_query("p24_campaign_states", f"""with e as ({_RUN_ROWS.format(customer="customer")}), s as ({_STUCK_ROWS.format(customer="customer")}),
g as (select campaign, count(*) filter (present) as experiments, bool_or(not present or coalesce(has_failures, false) or coalesce(run_status in ('error', 'canceled'), false)) as broken, count(run_status) filter (present) as runs,
 coalesce(bool_and(coalesce(run_status = 'completed', false)) filter (present), false) as done, coalesce(bool_and(coalesce(run_status = 'paused' and current_stage = 'score_critic' and stage_done = target_count, false)) filter (present), false) as paused from e group by 1),
k as (select campaign, bool_or(reason in {campaign.INVALID}) as spoilt, bool_and(reason in {campaign.RECOVERABLE}) as rec from s group by 1),
o as (select campaign, experiments, case when broken or coalesce(spoilt, false) then 'scientifically_invalid' when runs = 0 then 'preflight_clean' when done or paused then 'complete' when rec then 'stalled_recoverable' when not rec then 'stalled_unknown' else 'healthy_progressing' end as campaign_state from g left join k using (campaign))
select *, case campaign_state when 'scientifically_invalid' then 'scientifically_invalid' when 'complete' then 'scientifically_valid' else 'scientifically_unknown' end as scientific_validity from o""")
def _(spark, d):
    e, s = (spark.sql(q, customer=table(spark, d, "customer")) for q in (_RUN_ROWS, _STUCK_ROWS))
    return campaign.campaign_state(e, s, "campaign", pause_after="score_critic")


def _few(spark, d):
    """States of finer keys than a user's, so that some have no pending request."""
    r = requests(spark, d).withColumn("custom_key", F.concat(F.lit("run:"), (F.col("request_id") % 3000).cast("string"), F.lit(":"), F.element_at(F.split("custom_key", ":"), -1)))
    return ops.target_states(r)


_FEW = f"{_Q.replace('with r as', 'with r0 as')}, r as (select concat('run:', request_id % 3000, ':', split_part(custom_key, ':', 3)) as custom_key, request_id, ts, status, error, attempt_index from r0), {_STATES}"
@_query("a38_recoverable_stalls", f"{_FEW} select split_part(custom_key, ':', 2) as process, split_part(custom_key, ':', 3) as stage, count(*) filter (resolution = 'retryable') as retryable from s group by 1, 2 having count(*) filter (resolution = 'retryable') > 0 and count(*) filter (resolution = 'pending') = 0")
def _(spark, d):
    return campaign.recoverable_stalls(_few(spark, d))


@_query("a42_f40_retry_candidates", f"{_FEW} select custom_key, cast(coalesce(error_attempt, 0) + 1 as bigint) as next_attempt from s where resolution = 'retryable' and coalesce(error_attempt, 0) < 3")
def _(spark, d):
    return campaign.retry_candidates(_few(spark, d)).withColumn("next_attempt", F.col("next_attempt").cast("long"))


#: Batches with more states: some are being submitted or finalized, and polled at times.
_MORE = "select o_orderkey as batch_id, o_custkey as key, cast(o_orderdate as varchar(10)) as created, case o_orderkey % 5 when 0 then 'submitting' when 1 then 'running' when 2 then 'finalizing' when 3 then 'error' else 'success' end as status, case when o_orderkey % 3 = 0 then '' when o_orderkey % 7 = 0 then null else 'ref' end as ref, case when o_orderkey % 4 > 0 then cast(o_orderdate as varchar(10)) end as next_poll from {orders}"
_CUTOFF = "1996-06-30"
_STUCK = f"""{_FEW}, b as ({_BATCHES.format(orders='orders')}), p as (select request_id, case when request_id % 10 > 0 then request_id * 7 % 30000 end as batch_id from r where status = 'pending'), m as ({_MORE.format(orders='orders')}),
sw as (select 'stage_waiting_on_exhausted_requests' as reason, custom_key as subject from s where resolution = 'exhausted' union all select 'pending_requests_on_dead_transport', request_id::varchar from p left join b using (batch_id) where p.batch_id is not null and (b.batch_id is null or b.status = 'error')
 union all select 'retryable_no_transport', concat(split_part(custom_key, ':', 2), ':', split_part(custom_key, ':', 3)) from s group by split_part(custom_key, ':', 2), split_part(custom_key, ':', 3) having count(*) filter (resolution = 'retryable') > 0 and count(*) filter (resolution = 'pending') = 0
 union all select 'batch_missing_ref', batch_id::varchar from m where status in ('submitting', 'running', 'finalizing') and coalesce(ref, '') = '' and created <= '{_CUTOFF}' and not exists (select 1 from m o where o.key = m.key and o.batch_id <> m.batch_id and o.status in {campaign.LIVE} and coalesce(o.ref, '') <> '')
 union all select 'finalizing_no_progress', batch_id::varchar from m where status = 'finalizing' and coalesce(next_poll, created) <= '{_CUTOFF}' union all select 'pending_request_no_owner', request_id::varchar from p where batch_id is null)"""


def _stuck(spark, d):
    s, taken = _few(spark, d), requests(spark, d).withColumn("batch_id", F.when(F.col("request_id") % 10 > 0, F.col("request_id") * 7 % 30000))
    dead = campaign.dead_transport(taken.where("batch_id is not null"), _batches(spark, d))
    more = spark.sql(_MORE, orders=table(spark, d, "orders"))
    return campaign.stuck_work(s, dead, campaign.recoverable_stalls(s), campaign.stuck_batches(more, _CUTOFF), campaign.unowned(taken))


@_query("a39_stuck_work", f"{_STUCK} select * from sw")
def _(spark, d):
    return _stuck(spark, d)


@_query("a43_u5_repair_plan", f"{_STUCK}, ac(reason, action) as (values {', '.join(f"('{r}', '{n}')" for r, names in campaign.REPAIRS.items() for n in names)}) select distinct action, subject from sw join ac using (reason)")
def _(spark, d):
    return campaign.repair_plan(_stuck(spark, d))


@_query("a44_audited_counts", "with s as (select o_orderkey as k, o_orderkey % 8 as n from orders), c as (select l_orderkey as k, count(*) as n from lineitem group by 1) select coalesce(s.k, c.k) as sample_id, coalesce(s.n, 0) as stored, coalesce(c.n, 0) as computed, coalesce(s.n, 0) <> coalesce(c.n, 0) as changed from s full join c on s.k = c.k")
def _(spark, d):
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 8).alias("n"))
    return campaign.audit(stored, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count("*").alias("n")), "sample_id", "n")


@_query("p31_token_budget", "select source, lang, cast(sum(ceil(length(coalesce(text, '')) / 4.0)) as bigint) as tokens, sum(ceil(length(coalesce(text, '')) / 4.0)) <= 20000 as fits from documents group by 1, 2")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.struct("source", "lang"))
    return campaign.token_budget(docs, "key", "text").select("key.source", "key.lang", "tokens", "fits")


@_query("p32_valid_windows", "select o_orderkey, coalesce(try_cast(b as timestamp) >= try_cast(a as timestamp), false) as valid from (select o_orderkey, case when o_orderkey % 5 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end as a, case when o_orderkey % 7 = 0 then '1990-01-01' else '1996-06-30' end as b from orders)")
def _(spark, d):
    k = F.col("o_orderkey")
    w = table(spark, d, "orders").select(k, F.when(k % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("a"), F.when(k % 7 == 0, "1990-01-01").otherwise("1996-06-30").alias("b"))
    return campaign.valid_windows(w, "a", "b").select("o_orderkey", "valid")


@_query("p18_p19_batch_routes", """select o_orderkey, case when o_orderstatus = 'P' or o_orderkey % 60 < 30 then 'job' else 'batch' end as route, case o_orderkey % 7 when 1 then 'completed' when 0 then 'running' when 3 then 'running' else 'error' end as batch_status,
 case o_orderkey % 7 when 2 then 'batch_expired' when 4 then 'batch_unknown_status:odd' when 5 then 'batch_missing_status' when 6 then 'batch_missing_status' end as error from orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("in_progress", "COMPLETED", "expired", "cancelling", "odd", "", None))), (k % 7 + 1).cast("int"))
    b = campaign.batch_status(status)
    return table(spark, d, "orders").select(k, campaign.route(F.col("o_orderstatus") != "P", k % 60).alias("route"), b["status"].alias("batch_status"), b["error"].alias("error"))


@_query("j9_j10_u3_pending_targets", f"{_FEW}, t as (select concat('run:', o_orderkey % 4000, ':', case when o_orderkey % 2 = 0 then 'score_gen' else 'rubric_gen' end) as custom_key, o_orderkey from orders), dn as (select concat('run:', p_partkey, ':score_gen') as custom_key from part) select custom_key, o_orderkey from t where custom_key not in (select custom_key from dn) and custom_key not in (select custom_key from s where resolution in ('pending', 'exhausted'))")
def _(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.concat(F.lit("run:"), (k % 4000).cast("string"), F.when(k % 2 == 0, ":score_gen").otherwise(":rubric_gen")).alias("custom_key"), k)
    done = table(spark, d, "part").select(F.concat(F.lit("run:"), F.col("p_partkey").cast("string"), F.lit(":score_gen")).alias("custom_key"))
    return campaign.pending_targets(t, done, _few(spark, d), "custom_key")


_KEYS = """select event_id as request_id, concat(case event_id % 4 when 0 then 'sample' when 1 then 'sample_score_target' when 2 then 'evidence' else 'run' end, ':', case when event_id % 11 = 0 then '' else cast(user_id as varchar(20)) end,
 case when event_id % 13 = 0 then '' when event_id % 7 = 0 then ':' else ':rubric_gen' end, case when event_id % 3 = 0 then ':more' else '' end) as k from {events}"""


@_query("j11_f22_process_of_requests", f"""with k as ({_KEYS.format(events="events")}), p as (select request_id, split_part(k, ':', 1) as type, split_part(k, ':', 2) as id, split_part(k, ':', 3) as stage from k)
select * from p where type in {campaign.TARGETS} and id <> '' and stage <> '' and try_cast(id as bigint) in (select c_custkey from customer where c_nationkey < 12)""")
def _(spark, d):
    r = spark.sql(_KEYS, events=table(spark, d, "events")).select("request_id", campaign.key_parts(F.col("k")).alias("k")).select("request_id", "k.*")
    c = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("id"))
    return r.join(c, "id", "left_semi")


@_query("s23_s26_bounded_scan", "select event_id, event_type, (select count(*) from events where user_id = 5) > 20 as approximate from events where user_id = 5 order by event_id limit 20")
def _(spark, d):
    return campaign.bounded(table(spark, d, "events").where("user_id = 5").select("event_id", "event_type"), ["event_id"], 20)


@_query("s24_offset_page", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 100 offset 300")
def _(spark, d):
    return ops.offset_page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 300)


_RUBRIC = "select p_partkey, concat('Notes', chr(10), '1) ', p_name, ' :: ', p_brand, ' named; size ', p_size, ' (a; b); and ', p_type, chr(10), '2) two :: x, y, z', chr(10), '3) three :: only one') as raw from {part}"


@_query("f20_f26_f27_rubric_rows", f"""with p as ({_RUBRIC.format(part='part')}), s as (select p_partkey, 1 as stage_number, p_name as label, [concat(p_brand, ' named'), concat('size ', p_size, ' (a; b)'), p_type] as c from part union all select p_partkey, 2, 'two', ['x', 'y', 'z'] from part union all select p_partkey, 3, 'three', ['only one'] from part)
select p_partkey, stage_number, cast(unnest(range(1, len(c) + 1)) as int) as criterion_no, label, unnest(c) as criterion from s""")
def _(spark, d):
    p = spark.sql(_RUBRIC.replace("chr(10)", "'\\n'"), part=table(spark, d, "part"))
    stages = F.transform(text.rubric_stages(F.col("raw")), lambda s: F.struct(s["stage_number"].alias("stage_number"), s["label"].alias("label"), text.criteria(s["criteria"]).alias("criteria")))
    return campaign.rubric_rows(p.select("p_partkey", stages.alias("stages")), "p_partkey", "stages")


@_query("f19_f26_rubric_texts", "select p_partkey, concat('Concept: ', p_type, chr(10), 'Stage 1: ', p_name, '. ', p_brand, ' named; size ', p_size, ' (a; b); ', p_type, chr(10), 'Stage 2: two. x; y; z', chr(10), 'Stage 3: three. only one') as rubric, 'invalid criteria count' as wrong from part")
def _(spark, d):
    p = spark.sql(_RUBRIC.replace("chr(10)", "'\\n'").replace("as raw", "as raw, p_type"), part=table(spark, d, "part"))
    raw = text.rubric_stages(F.col("raw"))
    stages = F.transform(raw, lambda s: F.struct(s["stage_number"].alias("stage_number"), s["label"].alias("label"), text.criteria(s["criteria"]).alias("criteria")))
    return p.select("p_partkey", campaign.rubric_text(F.col("p_type"), stages).alias("rubric"), text.rubric_errors(raw, F.lit(3)).alias("wrong"))


@_query("f28_quality_scores", "select conv_id, turn, ((round(cast((conv_id % 10) / 10.0 as double), 9)) + 0.0) as observability, cast(case when turn % 2 = 0 then 1.0 else 0.25 end as double) as discriminability from conversations")
def _(spark, d):
    raw = F.concat(F.lit("x\nQUALITY: observability=0 discriminability=0\nquality: observability = 0."), (F.col("conv_id") % 10).cast("string"), F.when(F.col("turn") % 2 == 0, ", discriminability=1.5").otherwise(" discriminability= 0.25"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.quality(raw).alias("q")).select("conv_id", "turn", "q.*")


@_query("r7_f24_f39_texts", "select doc_id, sha256(coalesce(text, '')) as content_hash, case when length(text) > 1600 then concat(substring(text, 1, 1600), '…') else text end as payload, strftime(timestamp '2024-01-01' + to_days(cast(doc_id % 300 as int)), '%m/%d/%Y') as shown from documents")
def _(spark, d):
    shown = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "MM/dd/yyyy")
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), campaign.truncated(F.col("text")).alias("payload"), shown.alias("shown"))


@_query("w3_evidence_labels", "select source, doc_id, concat('E', row_number() over (partition by source order by doc_id)) as label from documents where doc_id is not null")
def _(spark, d):
    return bundles.evidence_labels(table(spark, d, "documents").where("doc_id is not null").select("source", "doc_id"), "source", "doc_id")


@_query("w4_w5_bundle_order", "select o_custkey, o_orderpriority, cast(row_number() over (partition by o_custkey order by split_part(o_orderpriority, '-', 1)::int, o_orderpriority) as int) as place, cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as int) as group_no from (select distinct o_custkey, o_orderpriority from orders)")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    return bundles.bundle_order(rows, "o_custkey", "o_orderpriority")


@_query("bp10_pools", "select source as pool, count(distinct text) as evidence from documents where text is not null group by 1")
def _(spark, d):
    return bundles.pools(table(spark, d, "documents"), "source", "text").withColumnRenamed("source", "pool")
