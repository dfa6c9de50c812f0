"""Every operator of the study as a query over the tables at hand, and the same in DuckDB's SQL where SQL can express it.

The key's first part names the rows of the operator inventory that a query covers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.verdicts import rounded
from assayer.operators import belief, bundles, contrasts, geometry, ops, pools, text
from assayer.operators import resampling as rs
from assayer.sources.fixtures import REQUESTS, RESPONSES, requests, responses, table
from assayer.streaming import events as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_R = f"with r as ({RESPONSES.format(lineitem='lineitem')})"
_Q = f"with r as ({REQUESTS.format(events='events')})"


def _query(name: str, sql: str | None = None, nudge: float = 0.0):
    """Register a query; its doubles are rounded, as ``n<x>n`` rounds them in the SQL. Products of beliefs have ties and need a nudge."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(rounded(F.col(c), nudge=nudge).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = re.sub(r"\bn<(.*?)>n\b", rf"(round(cast(\1 as double) + {nudge}, 9) + 0.0)", sql, flags=re.S)
        return f

    return add


_POP = "bit_count(mask)"
_SIZES = "case when mask <> 0 then bit_count(mask) end"
_EXP = "case when mask <> 0 then list_sum(list_filter(range(1, scale_size + 1), lambda s: (mask & (1::bigint << (s - 1))) <> 0)) / bit_count(mask)::double end"
_LABEL = "case when mask = 0 then 'ABSTAIN' else '[' || array_to_string(list_filter(range(1, scale_size + 1), lambda s: (mask & (1::bigint << (s - 1))) <> 0), ',') || ']' end"
_SPREAD = "case when (mask & (1::bigint << (stage - 1))) <> 0 then 1.0::double / bit_count(mask) else 0 end"
_STAGED = f"st as (select *, unnest(range(1, scale_size + 1)) as stage from r), sp as (select *, {_SPREAD} as p from st)"
_RATES = f"""count(*) as response_rows, avg((mask = 0)::int) as abstain_rate, avg(case when mask <> 0 then (bit_count(mask) = 1)::int end) as singleton_rate,
 avg({_SIZES}) as mean_subset_size, avg({_EXP}) as mean_expected_stage, avg(agreement) as mean_agreement"""
_RATE_COLUMNS = "response_rows, n<abstain_rate>n as abstain_rate, n<singleton_rate>n as singleton_rate, n<mean_subset_size>n as mean_subset_size, n<mean_expected_stage>n as mean_expected_stage, n<mean_agreement>n as mean_agreement"
_SM = f"""{_STAGED}, rate as (select experiment_tag, sample_ordinal, {_RATES}, count(distinct bundle_no) as unique_bundle_count, array_to_string(list_sort(list(distinct bundle_no::varchar)), ' | ') as bundle_signature from r group by 1, 2),
mass as (select experiment_tag, sample_ordinal, scale_size, stage, coalesce(sum(p) / nullif(count(*) filter (mask <> 0), 0), 0) as m from sp group by 1, 2, 3, 4),
shape as (select experiment_tag, sample_ordinal, sum(case when stage > 1 and stage < scale_size then m else 0 end) as mid_scale_mass, sum(case when m > 0 then -m * log2(m) else 0 end) / log2(max(scale_size)) as stage_entropy from mass group by 1, 2),
sm as (select * from rate join shape using (experiment_tag, sample_ordinal))"""


@_query("a5_experiment_geometry", f"""{_R}, {_STAGED}, mass as (select experiment_tag, scale_size, stage, sum(p) / count(*) as m from sp group by 1, 2, 3)
select experiment_tag, n<1 - sum(m)>n as abstain_mass, {", ".join(f"n<coalesce(sum(m) filter (stage = {s}), 0)>n as mass_stage_{s}" for s in range(1, 10))},
 n<sum(case when stage > 1 and stage < scale_size then m else 0 end)>n as mid_scale_mass, n<sum(case when m > 0 then -m * log2(m) else 0 end) / log2(max(scale_size))>n as stage_entropy from mass group by 1""")  # fmt: skip
def _(spark, d):
    return geometry.experiment_geometry(responses(spark, d))


@_query("a1_experiment_metrics", f"{_R} select experiment_tag, {_RATE_COLUMNS}, samples, bundles, n<mean_observability>n as mean_observability, n<mean_discriminability>n as mean_discriminability from (select experiment_tag, {_RATES}, count(distinct sample_ordinal) as samples, count(distinct bundle_no) as bundles, avg(obs) as mean_observability, avg(disc) as mean_discriminability from r group by 1)")
def _(spark, d):
    return geometry.experiment_metrics(responses(spark, d))


@_query("a3_sample_metrics", f"{_R}, {_SM} select experiment_tag, sample_ordinal, {_RATE_COLUMNS}, unique_bundle_count, bundle_signature, n<mid_scale_mass>n as mid_scale_mass, n<stage_entropy>n as stage_entropy from sm")
def _(spark, d):
    return geometry.sample_metrics(responses(spark, d))


@_query("a4_evidence_metrics", f"{_R} select experiment_tag, sample_ordinal, bundle_no, {_RATE_COLUMNS} from (select experiment_tag, sample_ordinal, bundle_no, {_RATES} from r group by 1, 2, 3)")
def _(spark, d):
    return geometry.evidence_metrics(responses(spark, d))


@_query("a6_bundle_verdict_profiles", f"{_R} select experiment_tag, bundle_no, verdict, count(*) as n, n<avg(agreement)>n as mean_agreement, n<count(*) / sum(count(*)) over (partition by experiment_tag, bundle_no)>n as share from (select *, {_LABEL} as verdict from r) group by 1, 2, 3")
def _(spark, d):
    return geometry.bundle_verdict_profiles(responses(spark, d))


_STAGES = "list_filter(range(1, scale_size + 1), lambda s: (mask & (1::bigint << (s - 1))) <> 0)"


@_query("a7_verdict_geometry_certainty", f"""{_R}, b as (select *, {_LABEL} as verdict, case when mask = 0 then 'abstain' when {_POP} = 1 then 'singleton' when {_POP} >= 3 then 'broad_subset'
 when list_max({_STAGES}) - list_min({_STAGES}) = 1 then 'adjacent_subset' else 'non_adjacent_subset' end as bucket from r)
select experiment_tag, scale_size, verdict, bucket, count(*) as n, n<avg(agreement)>n as mean_agreement, n<avg(obs)>n as mean_observability, n<count(*) / sum(count(*)) over (partition by experiment_tag)>n as share from b group by 1, 2, 3, 4""")  # fmt: skip
def _(spark, d):
    return geometry.verdict_certainty(responses(spark, d))


def _bet(keys: str, closed: bool, name: str) -> str:
    v = "a" if closed else "a * obs * disc"
    rows = f"(select * from r where mask <> 0)" if closed else "r"
    frame = "1" if closed else "a"
    return f"""{name}x as (select *, agreement as a, unnest(range(0, 1::bigint << scale_size)) as s from {rows}),
{name}q as (select {keys}, scale_size, s, product(case when s = 0 then 1.0 when mask = 0 then 1 - a when mask = (1::bigint << scale_size) - 1 then {frame} when (s & ~mask) = 0 then 1.0 else 1 - {v} end) as q from {name}x group by all),
{name}c as (select {keys}, scale_size, sum(case when bit_count(s) % 2 = 0 then q else -q end) as conflict from {name}q group by all),
{name}g as (select {keys}, scale_size, stage, sum(case when (s & (1::bigint << (stage - 1))) <> 0 then (case when bit_count(s) % 2 = 0 then -q else q end) / bit_count(s) else 0 end) as raw
 from (select *, unnest(range(1, scale_size + 1)) as stage from {name}q where s <> 0) group by all),
{name} as (select {keys}, cast(stage as int) as stage, case when conflict >= 0.9999 then 0 else raw / greatest(1 - conflict, 1e-12) end as bet_p, conflict from {name}g join {name}c using ({keys}, scale_size))"""


_S = "experiment_tag, sample_ordinal"


_SB = f"""{_SM}, {_bet(_S, False, 'wo')}, {_bet(_S, True, 'wc')}, so as (select {_S}, max(conflict) as tbm_conflict, sum(stage * bet_p) as tbm_expected_stage from wo group by all),
sc as (select {_S}, max(conflict) as closed_world_conflict, sum(stage * bet_p) as closed_world_expected_stage from wc group by all),
sb as (select * from sm left join so using ({_S}) left join sc using ({_S}))"""
_EC = "ec as (select * from (select experiment_tag, " + _RATES + " from r group by 1) left join (select experiment_tag, avg(tbm_conflict) as mean_tbm_conflict, avg(closed_world_conflict) as mean_closed_world_conflict from sb group by 1) using (experiment_tag))"
_BELIEF = ("tbm_conflict", "tbm_expected_stage", "closed_world_conflict", "closed_world_expected_stage")


def _samples(spark, d):
    r = responses(spark, d)
    return geometry.with_belief(geometry.sample_metrics(r), r)


def _experiments(spark, d):
    return geometry.experiment_conflicts(geometry.experiment_metrics(responses(spark, d)), _samples(spark, d))


@_query("j18_samples_with_belief", f"{_R}, {_SB} select {_S}, n<mean_expected_stage>n as mean_expected_stage, {', '.join(f'n<{c}>n as {c}' for c in _BELIEF)} from sb", nudge=3.7e-13)
def _(spark, d):
    return _samples(spark, d).select(*geometry.SAMPLE, "mean_expected_stage", *_BELIEF)


_VALUES = ("subset_size", "expected_stage", "certainty")


@_query("a8_w16_f12_robust_summary_panel", f"""{_R}, v as (select experiment_tag, (mask = 0)::int as abstained, {_SIZES} as subset_size, {_EXP} as expected_stage, agreement as certainty from r),
l as (unpivot (select experiment_tag, {", ".join(f"cast({c} as double) as {c}" for c in _VALUES)} from v) on {", ".join(_VALUES)} into name name value x),
k as (select *, row_number() over (partition by experiment_tag, name order by x) as pos, count(*) over (partition by experiment_tag, name) as n from l where x is not null),
t as (select experiment_tag, {", ".join(f"avg(x) filter (name = '{c}') as {c}_t" for c in _VALUES)} from k where pos > floor(n * 0.1) and pos <= n - floor(n * 0.1) group by 1)
select experiment_tag, n<avg(abstained)>n as abstain_rate, {", ".join(f"n<quantile_cont({c}, 0.5)>n as {c}_median, n<quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)>n as {c}_iqr, n<max({c}_t)>n as {c}_trimmed_mean" for c in _VALUES)}
from v left join t using (experiment_tag) group by 1""")  # fmt: skip
def _(spark, d):
    return geometry.robust_panel(responses(spark, d))


_INST = geometry.INSTABLE


@_query("a9_sample_instability", f"""{_R}, {_SB}, i as (select sample_ordinal, count(distinct experiment_tag) as experiments, {", ".join(f"coalesce(stddev_samp({m}), 0) as {m}_std" for m in _INST)} from sb group by 1)
select sample_ordinal, experiments, {", ".join(f"n<{m}_std>n as {m}_std" for m in _INST)}, n<{" + ".join(f"{m}_std" for m in _INST[:4])}>n as instability from i""")  # fmt: skip
def _(spark, d):
    return geometry.sample_instability(_samples(spark, d))


_DIST = geometry.DISTANT


@_query("j28_w9_experiment_distances", f"""{_R}, {_SB}, {_EC}, z as (select experiment_tag, {", ".join(f"coalesce(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 0) as {c}" for c in _DIST)} from ec)
select a.experiment_tag as left_tag, b.experiment_tag as right_tag, n<sqrt({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _DIST)})>n as distance from z a join z b on a.experiment_tag < b.experiment_tag""")  # fmt: skip
def _(spark, d):
    return geometry.experiment_distances(_experiments(spark, d))


@_query("b3_b4_belief_tbm", f"{_R}, {_bet(_S, False, 'b')} select {_S}, stage, n<bet_p>n as bet_p, n<conflict>n as conflict from b", nudge=3.7e-13)
def _(spark, d):
    return belief.by_stage(belief.beliefs(responses(spark, d), geometry.SAMPLE), geometry.SAMPLE)


@_query("b3_b4_belief_closed_world", f"{_R}, {_bet(_S, True, 'b')} select {_S}, stage, n<bet_p>n as bet_p, n<conflict>n as conflict from b", nudge=3.7e-13)
def _(spark, d):
    return belief.by_stage(belief.beliefs(responses(spark, d), geometry.SAMPLE, closed=True), geometry.SAMPLE)


@_query("b5_bundle_belief_tbm", f"{_R}, {_bet('response_id', False, 'b')} select experiment_tag, bundle_no, stage, n<sum(w * bet_p) / sum(w)>n as bet_p from b join (select response_id, experiment_tag, bundle_no, case when obs * disc > 0 then obs * disc else 1 end as w from r) using (response_id) group by 1, 2, 3")
def _(spark, d):
    return belief.bundle_belief(responses(spark, d))


@_query("a17_a20_conflict_summary", f"{_R}, {_bet(_S, False, 'b')} select experiment_tag, n<avg(conflict)>n as mean_conflict from (select distinct {_S}, conflict from b) group by 1")
def _(spark, d):
    b = belief.beliefs(responses(spark, d), geometry.SAMPLE)
    return b.groupBy(*geometry.SAMPLE).agg(F.max("conflict").alias("conflict")).groupBy("experiment_tag").agg(F.avg("conflict").alias("mean_conflict"))


_POOL = f"""{_STAGED}, wt as (select *, case when sum(agreement) over (partition by {_S}) > 0 then agreement else 1 end as w from r where mask <> 0),
ws as (select *, unnest(range(1, scale_size + 1)) as stage from wt), wp as (select *, {_SPREAD} as p from ws),
p3 as (select {_S}, cast(stage as int) as stage, avg(p) as geometry, sum(w * p) / sum(w) as linear, exp(sum(w * ln(greatest(p, 1e-12))) / sum(w)) as lg from wp group by 1, 2, 3),
p4 as (select *, lg / sum(lg) over (partition by {_S}) as lo from p3),
{_bet(_S, False, 'bo')}, {_bet(_S, True, 'bc')},
pool as (select {_S}, 'geometry' as method, stage, geometry as p, cast(null as double) as conflict from p4 union all select {_S}, 'linear', stage, linear, null from p4 union all select {_S}, 'log', stage, lo, null from p4
 union all select {_S}, 'tbm', stage, bet_p, conflict from bo union all select {_S}, 'closed_world', stage, bet_p, conflict from bc),
me as (select {_S}, method, case when sum(p) > 0 then sum(stage * p) / sum(p) end as expected_stage, case when sum(p) > 0 then max(p) / sum(p) end as top_p, max(conflict) as conflict from pool group by 1, 2, 3)"""


def _methods(spark, d):
    return pools.sample_methods(pools.methods_beside(responses(spark, d)))


@_query("m1_m4_sample_methods", f"{_R}, {_POOL} select {_S}, method, n<expected_stage>n as expected_stage, n<top_p>n as top_p, n<conflict>n as conflict from me", nudge=3.7e-13)
def _(spark, d):
    return _methods(spark, d)


@_query("a13_method_summary", f"{_R}, {_POOL} select experiment_tag, method, count(*) as n, n<avg(expected_stage)>n as mean_expected_stage, n<avg(top_p)>n as mean_top_p, n<avg(conflict)>n as mean_conflict from me group by 1, 2")
def _(spark, d):
    return pools.method_summary(_methods(spark, d))


@_query("a14_j21_method_alignment", f"{_R}, {_POOL} select m.experiment_tag, m.method, n<avg(abs(m.expected_stage - b.expected_stage))>n as mean_absolute, n<avg(m.expected_stage - b.expected_stage)>n as bias, count(m.expected_stage - b.expected_stage) as n from me m join me b on b.method = 'linear' and m.experiment_tag = b.experiment_tag and m.sample_ordinal = b.sample_ordinal where m.method <> 'linear' group by 1, 2")
def _(spark, d):
    return pools.method_alignment(pools.methods_beside(responses(spark, d)))


_PAIRS = "ct as (select concat('toggle_', x) as contrast_id, concat('v3_a1_', x) as baseline_tag, concat('v3_b1_', x) as variant_tag from (select distinct split_part(experiment_tag, '_', 3) as x from r))"


@_query("a15_j22_contrast_sensitivity", f"{_R}, {_POOL}, {_PAIRS} select contrast_id, method, count(*) as n, n<avg(d)>n as mean_delta, n<quantile_cont(d, 0.5)>n as median_delta, n<stddev_pop(d)>n as std_delta from (select contrast_id, a.method, b.expected_stage - a.expected_stage as d from ct join me a on a.experiment_tag = baseline_tag join me b on b.experiment_tag = variant_tag and b.sample_ordinal = a.sample_ordinal and b.method = a.method) where d is not null group by 1, 2")
def _(spark, d):
    r = responses(spark, d)
    return pools.contrast_sensitivity(pools.methods_beside(r), contrasts.paired_families(r))


_MATCH = f"""{_SM}, {_PAIRS}, ar as (select contrast_id, sample_ordinal, max(response_rows) filter (experiment_tag = baseline_tag) as rb, max(response_rows) filter (experiment_tag = variant_tag) as rv from ct join sm on experiment_tag in (baseline_tag, variant_tag) group by 1, 2),
mt as (select contrast_id, sample_ordinal, rb is not null as has_baseline, rv is not null as has_variant, coalesce(rb = rv, false) as comparable from ar)"""


def _matched(spark, d):
    s = geometry.sample_metrics(responses(spark, d))
    c = contrasts.paired_families(s)
    return s, c, contrasts.matching(s, c)


_SEEN = {"window_id": "bundle_no % 2", "bundle_size": "bundle_no % 3 + 1"}
_SIG = lambda e: f"array_to_string(list_sort(list(distinct ({e})::varchar)), ' | ')"
_MATCHED = f"""sg as (select experiment_tag, sample_ordinal, count(*) as n, {_SIG("bundle_no")} as b, {_SIG(_SEEN["window_id"])} as w, {_SIG(_SEEN["bundle_size"])} as z from r group by 1, 2), {_PAIRS},
ab as (select contrast_id, sg.* from ct join sg on experiment_tag = baseline_tag), av as (select contrast_id, sg.* from ct join sg on experiment_tag = variant_tag),
mw as (select contrast_id, sample_ordinal, ab.n is not null as has_baseline, av.n is not null as has_variant, coalesce(ab.b = av.b, false) as bundle_signature_match, coalesce(ab.w = av.w, false) as window_signature_match, coalesce(ab.z = av.z, false) as bundle_size_signature_match, coalesce(ab.n = av.n, false) as response_rows_match
 from ab full join av using (contrast_id, sample_ordinal)),
mt as (select *, window_signature_match and bundle_size_signature_match and response_rows_match as comparable, window_signature_match and bundle_size_signature_match and bundle_signature_match as strictly from mw)"""


def _windowed(spark, d, strict=False):
    s = geometry.sample_metrics(responses(spark, d).withColumns({c: F.expr(e) for c, e in _SEEN.items()}))
    return contrasts.matching(s, contrasts.paired_families(s), strict)


@_query("j19_matching_details", f"{_R}, {_MATCHED} select * from mt")
def _(spark, d):
    strictly = _windowed(spark, d, strict=True).select("contrast_id", "sample_ordinal", F.col("comparable").alias("strictly"))
    return _windowed(spark, d).join(strictly, ["contrast_id", "sample_ordinal"])


@_query("a11_matching_validation", f"{_R}, {_MATCHED} select contrast_id, count(*) filter (has_baseline) as n_baseline, count(*) filter (has_variant) as n_variant, count(*) filter (comparable) as n_matched, bool_and(comparable) as fully_matched, case when bool_and(comparable) then '{contrasts.NOTES[False][0]}' else '{contrasts.NOTES[False][1]}' end as note from mt group by 1")
def _(spark, d):
    return contrasts.matching_validation(_windowed(spark, d))


_DELTA = f"""{_MATCH}, lo as (unpivot (select experiment_tag, sample_ordinal, {", ".join(f"cast({e} as double) as {e}" for e in contrasts.ENDPOINTS)} from sm) on {", ".join(contrasts.ENDPOINTS)} into name endpoint value v),
ll as (select k.experiment_tag, k.sample_ordinal, e.endpoint, lo.v from (select distinct experiment_tag, sample_ordinal from sm) k cross join (select unnest([{", ".join(f"'{e}'" for e in contrasts.ENDPOINTS)}]) as endpoint) e left join lo on lo.experiment_tag = k.experiment_tag and lo.sample_ordinal = k.sample_ordinal and lo.endpoint = e.endpoint),
de as (select contrast_id, sample_ordinal, a.endpoint, a.v as baseline, b.v as variant, b.v - a.v as delta from mt join ct using (contrast_id) join ll a using (sample_ordinal) join ll b using (sample_ordinal) where comparable and a.experiment_tag = baseline_tag and b.experiment_tag = variant_tag and a.endpoint = b.endpoint)"""


def _deltas(spark, d):
    return contrasts.pair_deltas(*_matched(spark, d))


@_query("j20_family_pair_deltas", f"{_R}, {_DELTA} select contrast_id, sample_ordinal, endpoint, n<baseline>n as baseline, n<variant>n as variant, n<delta>n as delta from de")
def _(spark, d):
    return _deltas(spark, d)


_EFF = f"{_DELTA}, ef as (select contrast_id, endpoint, count(*) as n, avg(delta) as mean_delta, quantile_cont(delta, 0.5) as median_delta, coalesce(stddev_samp(delta), 0) as std_delta, avg((delta > 1e-12)::int) as positive_share from de where delta is not null group by 1, 2)"


@_query("a10_m8_family_effects", f"{_R}, {_EFF} select contrast_id, endpoint, n, n<mean_delta>n as mean_delta, n<median_delta>n as median_delta, n<std_delta>n as std_delta, n<positive_share>n as positive_share, n<case when std_delta > 0 then mean_delta / std_delta end>n as dz from ef")
def _(spark, d):
    return contrasts.effects(_deltas(spark, d))


def _draw_sql(sample: str, replicate: str) -> str:
    x = f"(({sample}) % {rs.PRIME} * {rs.OF_SAMPLE} + ({replicate}) % {rs.PRIME} * {rs.OF_REPLICATE} + {rs.MIX[2]}) % {rs.PRIME}"
    for m in rs.MIX[:2]:
        x = f"list_transform([{x}], lambda x: (x * x % {rs.PRIME} + x * {m} + 1) % {rs.PRIME})[1]"
    return x


_TIMES = "case " + " ".join(f"when x < {limit} then {k}" for k, limit in enumerate(rs.poisson_limits())) + f" else {len(rs.poisson_limits())} end"
_SUMMED = lambda t: ", ".join(f"sum({t} * {e}) as t_{e}, sum(case when {e} is not null then {t} end) as n_{e}" for e in contrasts.PRIMARY)
#: ``re``: interval and p-value of each contrast and endpoint; then ``qv`` with q-values by family, as all contrasts are of one, and ``rk``, ranked.
_RES = f"""{_EFF}, wd as materialized (select contrast_id, sample_ordinal, {", ".join(f"max(delta) filter (endpoint = '{e}') as {e}" for e in contrasts.PRIMARY)} from de group by 1, 2),
bo as (select contrast_id, i, {_SUMMED("t")} from (select *, {_TIMES} as t from (select wd.*, i, {_draw_sql("sample_ordinal", "i")} as x from wd, range(2000) g(i))) group by 1, 2),
fl as (select contrast_id, i, {_SUMMED("t")} from (select *, x % 2 * 2 - 1 as t from (select wd.*, i, {_draw_sql("sample_ordinal", f"i + {rs.FLIPS_FROM}")} as x from wd, range(5000) g(i))) group by 1, 2),
bm as ({" union all ".join(f"select contrast_id, '{e}' as endpoint, round(t_{e} / nullif(n_{e}, 0), 12) as m from bo" for e in contrasts.PRIMARY)}),
bq as (select contrast_id, endpoint, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bm group by 1, 2),
fm as ({" union all ".join(f"select contrast_id, '{e}' as endpoint, t_{e} as t from fl" for e in contrasts.PRIMARY)}),
fq as (select fm.contrast_id, fm.endpoint, count(*) filter (abs(t / n) >= abs(mean_delta) - {rs.EQUAL}) as far from fm join ef on ef.contrast_id = fm.contrast_id and ef.endpoint = fm.endpoint group by 1, 2),
re as (select ef.*, case when std_delta > 0 then mean_delta / std_delta end as dz, case when n = 1 then mean_delta else lo end as ci_low, case when n = 1 then mean_delta else hi end as ci_high, case when abs(mean_delta) < {rs.EQUAL} then 1.0 else (far + 1) / 5001.0::double end as p_value
 from ef join bq using (contrast_id, endpoint) join fq using (contrast_id, endpoint)),
qr as (select *, row_number() over (order by p_value, endpoint, contrast_id) as pos, count(*) over () as m from re), qv as (select *, least(1.0, min(p_value * m / pos) over (order by pos desc)) as q_value from qr),
rk as (select *, 3 * (q_value <= 0.05)::int + 2 * (q_value <= 0.1)::int + coalesce(abs(dz), 0) + 0.1 * abs(mean_delta) as rank_score from qv order by round(q_value, 9), round(abs(dz), 9) desc nulls last, round(abs(mean_delta), 9) desc, contrast_id, endpoint limit 25)"""


def _qvalues(spark, d):
    deltas = _deltas(spark, d).where(F.col("endpoint").isin(*contrasts.PRIMARY))
    both = contrasts.effects(deltas).join(rs.resampled(deltas), ["contrast_id", "endpoint"], "left")
    families = contrasts.registry(geometry.sample_metrics(responses(spark, d))).select("contrast_id", "family_slug")
    return contrasts.q_values(both.join(families, "contrast_id").withColumn("tie", F.struct("endpoint", "contrast_id")), keys=("family_slug",), tie="tie").drop("tie")


@_query("m6_m7_w11_family_effects_qvalues", f"""{_R}, {_RES} select contrast_id, endpoint, n, n<mean_delta>n as mean_delta, n<median_delta>n as median_delta, n<std_delta>n as std_delta, n<positive_share>n as positive_share, n<dz>n as dz, n<ci_low>n as ci_low, n<ci_high>n as ci_high, n<p_value>n as p_value,
 'a1_abstain_toggle' as family_slug, n<q_value>n as q_value, q_value <= 0.1 as is_significant_fdr_10, q_value <= 0.05 as is_significant_fdr_05 from qv""")
def _(spark, d):
    return _qvalues(spark, d)


@_query("y2_p11_contrast_registry", f"""{_R}, {_PAIRS} select contrast_id, 'a1_abstain_toggle' as family_slug, 'toggle' as contrast_kind, baseline_tag, variant_tag, concat('a1 ', split_part(contrast_id, '_', 2)) as baseline_label, concat('b1 ', split_part(contrast_id, '_', 2)) as variant_label, 'window_only' as match_mode from ct
where baseline_tag in (select experiment_tag from r) and variant_tag in (select experiment_tag from r)""")
def _(spark, d):
    return contrasts.registry(responses(spark, d))


@_query("w11_q_values", "with p as (select p_partkey as k, p_brand as g, (p_partkey * 37 % 1000 + 1) / 1001.0::double as p from part), a as (select *, row_number() over (partition by g order by p, k) as r, count(*) over (partition by g) as n from p) select k, g, n<p>n as p, n<least(1, min(p * n / r) over (partition by g order by r desc rows between unbounded preceding and current row))>n as q_value from a")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), ((F.col("p_partkey") * 37 % 1000 + 1) / 1001.0).alias("p"))
    return contrasts.q_values(p, "p", ("g",), "k").drop("is_significant_fdr_10", "is_significant_fdr_05")


@_query("k2_ranked_effects", f"""{_R}, {_RES} select contrast_id, endpoint, n<mean_delta>n as mean_delta, n<q_value>n as q_value, n<rank_score>n as rank_score, case when round(mean_delta, 9) > 0 then 'positive' when round(mean_delta, 9) < 0 then 'negative' else 'neutral' end as direction from rk""")
def _(spark, d):
    return contrasts.ranked_findings(_qvalues(spark, d)).select("contrast_id", "endpoint", "mean_delta", "q_value", "rank_score", "direction")


@_query("a22_j31_effect_contributors", f"""{_R}, {_RES}, c as (select sample_ordinal, abs(delta) as s, concat(contrast_id, ' | ', endpoint) as k from de join rk using (contrast_id, endpoint) where delta is not null)
select sample_ordinal, n<sum(s)>n as total, n<max(s)>n as largest, count(*) as n, min_by(k, {{'a': -round(s + 3.7e-10, 9), 'b': k}}) as largest_key from c group by 1 order by round(sum(s), 6) desc, round(max(s), 6) desc, count(*) desc, sample_ordinal limit 25""")
def _(spark, d):
    return contrasts.effect_contributors(_deltas(spark, d), contrasts.ranked_findings(_qvalues(spark, d)))


@_query("m13_j26_experiment_similarity", "with u as (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings), m as (select label, i, avg(x) as x from u group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from m group by 1) select a.label as left_group, b.label as right_group, n<sum(a.x * b.x) / max(na.n) / max(nb.n)>n as cosine from m a join m b using (i) join n na on na.label = a.label join n nb on nb.label = b.label group by 1, 2")
def _(spark, d):
    return text.centroid_cosine(table(spark, d, "embeddings"), "label", "embedding")


_TF = "t as (select {id} as id, unnest(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: length(x) >= 3)) as token from {table}), tf as (select id, token, count(*) as tf from t group by 1, 2), df as (select token, count(*) as df from tf group by 1), v as (select id, token, tf * (ln((1 + (select count(*) from {table}))::double / (1 + df)) + 1) as w from tf join df using (token))"


@_query("m17_f21_tfidf", f"with {_TF.format(id='doc_id', text='text', table='documents')} select id as doc_id, token, n<w>n as weight from v")
def _(spark, d):
    return text.tfidf(table(spark, d, "documents"), "doc_id", "text")


@_query("m18_sparse_cosine", f"with {_TF.format(id='item_id', text='text', table='benchmark')}, nn as (select id, sqrt(sum(w * w)) as n from v group by 1) select a.id as left_id, b.id as right_id, n<sum(a.w * b.w / na.n / nb.n)>n as cosine from v a join v b using (token) join nn na on na.id = a.id join nn nb on nb.id = b.id group by 1, 2")
def _(spark, d):
    v = text.tfidf(table(spark, d, "benchmark"), "item_id", "text")
    return text.sparse_cosine(v, v, "item_id")


_SAID = "select conv_id, turn, concat(text, case (conv_id + turn) % 5 when 0 then chr(10) || 'VERDICT: B' when 1 then chr(10) || '- VERDICT: VERDICT: `a, C.`' when 2 then chr(10) || 'verdict: ABSTAIN' when 3 then chr(10) || 'VERDICT: [A/d b]' || chr(10) || 'EXPERT_AGREEMENT: 0.75' else '' end) as raw from {conversations}"


@_query("f29_f32_parsed_verdicts", f"""with s as ({_SAID.format(conversations="conversations")}), l as (select conv_id, turn, raw, (conv_id + turn) % 5 as k from s)
select conv_id, turn, case k when 0 then [2] when 1 then [1, 3] when 2 then cast([] as int[]) when 3 then [1, 4, 2] end as stages, case k when 0 then 2 when 1 then 1 when 2 then 0 when 3 then 1 end as first_stage,
 n<case when k = 3 then 0.75 end>n as agreement, case when k < 4 then length(trim(regexp_extract(raw, '^(.*?)\\n[- ]*verdict:', 1, 'is'), chr(10) || ' ')) end as reasoning_chars from l where raw is not null""")
def _(spark, d):
    said = spark.sql(_SAID.format(conversations="{c}").replace("chr(10) ||", "'\\n' ||").replace("|| chr(10)", "|| '\\n'"), c=table(spark, d, "conversations")).where("raw is not null")
    raw = F.col("raw")
    chars = F.length(text.reasoning(raw)).cast("long")
    return said.select("conv_id", "turn", text.letters_to_stages(raw).alias("stages"), text.single_verdict(raw).alias("first_stage"), text.agreement(raw).alias("agreement"), chars.alias("reasoning_chars"))


@_query("a41_target_states", f"""{_Q}, g as (select custom_key, count(*) as attempts, count(*) filter (status = 'pending') as n_pending, count(*) filter (status = 'success') as n_success, count(*) filter (status = 'error') as n_error,
 max_by(request_id, {{'a': ts, 'b': request_id}}) as latest_request, max_by(request_id, {{'a': ts, 'b': request_id}}) filter (status = 'success') as success_request, max_by(request_id, {{'a': ts, 'b': request_id}}) filter (status = 'error') as error_request,
 min(ts) filter (status = 'pending') as oldest_pending, max_by(coalesce(attempt_index, 1), {{'a': ts, 'b': request_id}}) filter (status = 'error') as error_attempt, false as stored from r where status <> 'ignored' group by 1)
select *, case when n_pending > 0 then 'pending' when n_success > 0 then 'succeeded' when error_attempt >= 3 then 'exhausted' else 'retryable' end as resolution from g""")
def _(spark, d):
    return ops.target_states(requests(spark, d))


@_query("a24_a31_stage_progress", f"""{_Q}, g as (select custom_key, case when count(*) filter (status = 'pending') > 0 then 'p' when count(*) filter (status = 'success') > 0 then 's' when max_by(coalesce(attempt_index, 1), {{'a': ts, 'b': request_id}}) filter (status = 'error') >= 3 then 'e' else 'r' end as x from r where status <> 'ignored' group by 1)
select split_part(custom_key, ':', 3) as stage, count(*) filter (x = 's') as completed, count(*) filter (x = 'e') as failed, count(*) filter (x in ('p', 'r')) as pending, count(*) as total, case when count(*) filter (x in ('p', 'r')) > 0 then 'running' else 'completed' end as status from g group by 1""")
def _(spark, d):
    return ops.stage_progress(ops.target_states(requests(spark, d)))


_CLASS = "case " + " ".join(f"when {' or '.join(f'contains(lower(error), {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)})' for w in words)} then '{c}'" for c, words in ops.ERRORS.items()) + " else 'unknown' end"


@_query("p17_error_classes", f"""{_Q} select {_CLASS} as error_class, count(*) as n from r where status = 'error' group by 1""")
def _(spark, d):
    return ops.error_counts(requests(spark, d))


@_query("a40_trace_stages", "select user_id, event_type, count(*) as n, min(epoch_us(ts) // 1000) as first_ms, max(epoch_us(ts) // 1000) as last_ms, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as duration_ms from events group by 1, 2")
def _(spark, d):
    return ops.trace_stages(table(spark, d, "events"))


@_query("w13_w14_trace_terminals", "with p as (select user_id, count(*) as n, min(event_id) filter (event_type = 'error') as first_terminal, count(event_id) - count(distinct event_id) as repeated from events group by 1) select p.user_id, n, first_terminal, repeated, (select count(*) from events e where e.user_id = p.user_id and e.event_id > first_terminal) as after_terminal from p")
def _(spark, d):
    return ops.trace_terminals(table(spark, d, "events"))


@_query("w12_t11_last_events", 'select user_id, event_id, event_type, pos as "at" from (select user_id, event_id, event_type, cast(row_number() over (partition by user_id order by event_id desc) as int) as pos from events) where pos <= 32')
def _(spark, d):
    return ops.last_events(table(spark, d, "events").select("user_id", "event_id", "event_type"))


@_query("s25_keyset_page", "select event_id, event_type, cast(row_number() over (order by event_id) as int) as \"at\", (select count(*) from events where event_id > 100) > 50 as more from events where event_id > 100 order by event_id limit 50")
def _(spark, d):
    return ops.keyset_page(table(spark, d, "events").select("event_id", "event_type"), "event_id", 100, 50)


_RUNS = "select o_orderkey as run, o_orderdate as created, c_nationkey as experiment, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'paused' end as status from {orders} join {customer} on o_custkey = c_custkey"


@_query("a28_w10_experiment_list", f"with o as ({_RUNS.format(orders='orders', customer='customer')}) select experiment, max_by(run, {{'a': created, 'b': run}}) as latest_run, max_by(status, {{'a': created, 'b': run}}) as latest_status, count(*) as runs, count(*) filter (status = 'completed') as n_completed, count(*) filter (status = 'running') as n_running, count(*) filter (status = 'paused') as n_paused from o group by 1")
def _(spark, d):
    runs = spark.sql(_RUNS, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))
    return ops.latest_run(runs, "experiment", "created", "run", "status")


def _uniform_sql(seed: str, step: str) -> str:
    """The ``step``-th number, from 1, of the generator behind the seeded shuffles."""
    product = lambda a, b: f"((({a})::hugeint * ({b})) & 4294967295)::bigint"
    return f"""list_transform([((({seed}) + ({step}) * 1831565813::hugeint) & 4294967295)::bigint], lambda s:
 list_transform([{product("xor(s, s >> 15)", "1 | s")}], lambda t: list_transform([xor((t + {product("xor(t, t >> 7)", "61 | t")}) & 4294967295, t)], lambda v: xor(v, v >> 14) / 4294967296.0::double)[1])[1])[1]"""


def shuffle_sql(name: str, lists: str, seed: int) -> str:
    """``name``: each row of ``lists`` (``pool``, ``l``) with its list shuffled from the end."""
    j = f"floor({_uniform_sql(str(seed & 0xFFFFFFFF), 'len(l) - i + 1')} * i)::bigint + 1"
    swapped = "list_transform(l, lambda x, k: case when k = i then l[j] when k = j then l[i] else x end)"
    return f"""{name}w as (with recursive z as (select pool, l, len(l)::bigint as i from {lists} union all select pool, {swapped}, i - 1 from (select *, {j} as j from z where i > 1)) select pool, l from z where i <= 1),
{name} as (select pool, unnest(l) as item, unnest(range(1, len(l) + 1)) as pos from {name}w)"""


_ROBIN = f"""li as (select lang as pool, list(doc_id order by doc_id) as l from documents where lang is not null and doc_id is not null group by 1), {shuffle_sql("si", "li", 7)},
it as (select si.pool, source, doc_id, pos from si join documents on lang = pool and doc_id = item), wl as (select pool, list(f order by f) as l from (select pool, source, min(pos) as f from it group by 1, 2) group by 1), {shuffle_sql("sw", "wl", 7 ^ 0x9E3779B9)},
wf as (select pool, source, min(pos) as f from it group by 1, 2), wo as (select wf.pool, source, sw.pos as wpos from wf join sw on sw.pool = wf.pool and sw.item = f),
tu as (select it.*, wpos, row_number() over (partition by it.pool, it.source order by pos) as turn from it join wo on wo.pool = it.pool and wo.source is not distinct from it.source),
o as (select *, row_number() over (partition by pool order by turn, wpos) as at_ from tu)"""


@_query("w17_bp1_bp2_bp5_bundles", f"""with {_ROBIN}, b as (select *, cast(floor((at_ - 1) / 5) + 1 as bigint) as bundle from o) select pool as lang, bundle, count(*) as size, array_to_string(list_sort(list(doc_id::varchar)), '|') as signature from b group by 1, 2""")
def _(spark, d):
    at = bundles.round_robin(table(spark, d, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 7)
    return bundles.bundle_rows(bundles.chunked(at, "lang", "at", 5), "lang", "doc_id")


@_query("r3_bp3_seeded_bundles", f"""with li as (select source as pool, list(doc_id order by doc_id) as l from documents where source is not null and doc_id is not null group by 1), {shuffle_sql("si", "li", 7)},
b as (select *, cast(floor((pos - 1) / 5) + 1 as bigint) as bundle from si) select pool, bundle, count(*) as size, array_to_string(list_sort(list(item::varchar)), '|') as signature from b group by 1, 2""")
def _(spark, d):
    items = table(spark, d, "documents").select(F.col("source").alias("pool"), F.col("doc_id").alias("item_id"))
    return bundles.bundle_rows(bundles.chunked(bundles.seeded_shuffle(items, "pool", "item_id", 7), "pool", "at", 5), "pool", "item_id")


@_query("m10_length_bias", f"{_R}, {_STAGED}, x as (select experiment_tag, ((mask & (1::bigint << (stage - 1))) <> 0)::int as selected, (obs * stage)::double as len from sp) select experiment_tag, n<regr_slope(selected, len)>n as slope, regr_count(selected, len)::bigint as n from x group by 1")
def _(spark, d):
    from assayer.functions.verdicts import has

    st = responses(spark, d).withColumn("stage", F.explode(F.sequence(F.lit(1), F.col("scale_size").cast("int"))))
    st = st.select("experiment_tag", has(F.col("mask"), F.col("stage")).cast("int").alias("selected"), (F.col("obs") * F.col("stage")).alias("len"))
    return st.groupBy("experiment_tag").agg(F.regr_slope("selected", "len").alias("slope"), F.regr_count("selected", "len").alias("n"))


@_query("t12_tumbling_counts", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, n<sum(value)>n as total from events group by 1, 2")
def _(spark, d):
    return live.tumbling_counts(table(spark, d, "events"))


@_query("x_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as \"end\", count(*) as n from s group by user_id, k")
def _(spark, d):
    return live.sessions(table(spark, d, "events"))
