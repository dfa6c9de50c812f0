"""Queries of the report tables, beside those of ``plans.queries`` and registered with them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from assayer.functions.verdicts import FAMILIES, bucket_of_label, family, family_slug, variant
from assayer.operators import belief, contrasts, geometry, pools, reports, text
from assayer.operators.regression import least_squares
from assayer.plans.queries import _BELIEF, _DELTA, _EC, _EFF, _EXP, _LABEL, _PAIRS, _POOL, _R, _RES, _S, _SB, _SIZES, _SM, _STAGED, QUERIES, _bet, _deltas, _experiments, _matched, _methods, _query, _qvalues, _samples  # noqa: F401
from assayer.sources.checkpoints import checkpointed
from assayer.sources.fixtures import responses, table

_RATE = "count(*) as n, avg((mask = 0)::int) as abstain_rate, avg(case when mask <> 0 then (bit_count(mask) = 1)::int end) as singleton_rate"
_RATED = "n, n<abstain_rate>n as abstain_rate, n<singleton_rate>n as singleton_rate"
_NUDGE = 3.7e-13
_MEASURES = ["abstain_rate", "singleton_rate", "mean_subset_size", "mean_expected_stage", "mean_agreement"]


@_query("a2_family_summary", f"""{_R}, e as (select experiment_tag, avg((mask = 0)::int) as abstain_rate, avg(case when mask <> 0 then (bit_count(mask) = 1)::int end) as singleton_rate, avg({_SIZES}) as mean_subset_size, avg({_EXP}) as mean_expected_stage, avg(agreement) as mean_agreement from r group by 1)
select split_part(experiment_tag, '_', 2) as family_code, case split_part(experiment_tag, '_', 2) when 'a1' then 'a1_abstain_toggle' else 'b1_small_model_family' end as family_slug, count(*) as experiments, {", ".join(f"n<avg({c})>n as {c}" for c in _MEASURES)} from e group by 1, 2""")
def _(spark, d):
    return reports.family_summary(geometry.experiment_metrics(responses(spark, d)), _MEASURES)


@_query("a18_bundle_rates", f"{_R} select experiment_tag, bundle_no, {_RATED} from (select experiment_tag, bundle_no, {_RATE} from r group by 1, 2)")
def _(spark, d):
    return reports.bundle_rates(responses(spark, d))


@_query("a46_rates_with_total", f"{_R} select experiment_tag, bundle_no, {_RATED} from (select experiment_tag, bundle_no, {_RATE} from r group by 1, 2 union all select experiment_tag, null, {_RATE} from r group by 1)")
def _(spark, d):
    return reports.bundle_rates(responses(spark, d), total=True)


@_query("a19_stage_counts", f"""{_R}, k as (select distinct experiment_tag, bundle_no, scale_size from r), every as (select experiment_tag, bundle_no, unnest(list_concat(list_transform(range(1, scale_size + 1), lambda x: x::varchar), ['ABSTAIN'])) as stage from k),
c as (select experiment_tag, bundle_no, unnest(case when mask = 0 then ['ABSTAIN'] else list_transform(list_filter(range(1, scale_size + 1), lambda s: (mask & (1::bigint << (s - 1))) <> 0), lambda x: x::varchar) end) as stage from r)
select experiment_tag, bundle_no, stage, coalesce(n, 0) as n from every left join (select experiment_tag, bundle_no, stage, count(*) as n from c group by 1, 2, 3) using (experiment_tag, bundle_no, stage)""")
def _(spark, d):
    return reports.stage_counts(responses(spark, d))


_CERTAIN = f"""vc as (select experiment_tag, verdict, bucket, count(*) as n, avg(agreement) as mean_agreement from (select *, {_LABEL} as verdict, case when mask = 0 then 'abstain' when bit_count(mask) = 1 then 'singleton' when bit_count(mask) >= 3 then 'broad_subset'
 when (mask & (mask >> 1)) <> 0 then 'adjacent_subset' else 'non_adjacent_subset' end as bucket from r) group by 1, 2, 3)"""


@_query("a21_verdict_heatmap", f"{_R}, {_CERTAIN} select experiment_tag, bucket, cast(sum(n) as bigint) as n, max(n) as largest, n<avg(mean_agreement)>n as mean_agreement from vc group by 1, 2")
def _(spark, d):
    return reports.bucket_heatmap(geometry.verdict_certainty(responses(spark, d)))


@_query("p10_k10_verdict_order", f"""{_R}, {_CERTAIN}, o as (select experiment_tag, verdict, bucket, n, cast(row_number() over (partition by experiment_tag order by verdict = 'ABSTAIN', len(verdict), verdict) as int) as place from vc) select * from o""")
def _(spark, d):
    v = reports.verdict_order(geometry.verdict_certainty(responses(spark, d)).select("experiment_tag", "verdict", "n"))
    return v.select("experiment_tag", "verdict", bucket_of_label(F.col("verdict")).alias("bucket"), "n", "place")


@_query("k12_label_pages", f"{_R}, {_CERTAIN} select experiment_tag, verdict, cast(floor((row_number() over w - 1) / 6) + 1 as bigint) as page, cast((row_number() over w - 1) % 6 + 1 as int) as slot from vc window w as (partition by experiment_tag order by n desc, verdict)")
def _(spark, d):
    return reports.label_pages(geometry.verdict_certainty(responses(spark, d)).select("experiment_tag", "verdict", "n"), "experiment_tag", [F.desc("n"), F.col("verdict")], 6).drop("n")


@_query("a47_verdict_matrix", f"{_R} select experiment_tag, bundle_no, verdict, count(*) as n, n<avg(coalesce(agreement, 1))>n as mean_agreement from (select *, {_LABEL} as verdict from r) group by 1, 2, 3")
def _(spark, d):
    return reports.verdict_matrix(responses(spark, d))


@_query("j17_profiles_with_totals", f"""{_R}, p as (select experiment_tag, bundle_no, {_LABEL} as verdict, count(*) as n, avg(agreement) as mean_agreement from r group by 1, 2, 3), b as (select experiment_tag, bundle_no, {_RATE} from r group by 1, 2)
select p.experiment_tag, p.bundle_no, verdict, p.n, n<mean_agreement>n as mean_agreement, b.n as bundle_n, n<abstain_rate>n as bundle_abstain_rate from p left join b on p.experiment_tag is not distinct from b.experiment_tag and p.bundle_no is not distinct from b.bundle_no""")
def _(spark, d):
    r = responses(spark, d)
    return reports.profiles_with_totals(reports.verdict_matrix(r), reports.bundle_rates(r))


def _q(spark, d, closed=False):
    return belief.commonalities(responses(spark, d), geometry.SAMPLE, closed)


_COMB = f"""{_bet(_S, False, 'b')}, t as (select {_S}, max(conflict) as conflict, round(max(round(bet_p, 9)), 9) as max_bet_p from b group by 1, 2),
cb as (select t.experiment_tag, t.sample_ordinal, t.conflict, round(t.conflict, 9) < 0.9 as usable, max_bet_p, min(b.stage) as modal_stage from t join b on t.experiment_tag = b.experiment_tag and t.sample_ordinal = b.sample_ordinal and round(b.bet_p, 9) = max_bet_p group by all)"""


@_query("b6_support", f"""{_R}, {_bet(_S, False, 'b')}, sup as (select {_S}, st.stage, sum(case when (s & (1::bigint << (st.stage - 1))) <> 0 then (case when bit_count(s) % 2 = 1 then q else -q end) else 0 end) as bel, max(case when s = (1::bigint << (st.stage - 1)) then q end) as pl
 from (select *, unnest(range(1, scale_size + 1)) as stage from bq) st group by 1, 2, 3) select sup.experiment_tag, sup.sample_ordinal, cast(sup.stage as int) as stage, n<bel>n as bel, n<pl>n as pl, n<bet_p>n as bet_p, n<conflict>n as conflict from sup join b using ({_S}, stage)""", nudge=_NUDGE)
def _(spark, d):
    return belief.support(_q(spark, d), geometry.SAMPLE)


@_query("a49_conflict_summary", f"{_R}, {_COMB} select experiment_tag, count(*) as n, n<avg(usable::int)>n as usable_share, n<avg(conflict)>n as mean_conflict, n<quantile_cont(conflict, 0.5)>n as median_conflict, n<avg(max_bet_p)>n as mean_conviction from cb group by 1", nudge=_NUDGE)
def _(spark, d):
    return reports.conflict_summary(belief.combined(belief.beliefs(responses(spark, d), geometry.SAMPLE), geometry.SAMPLE))


_BS = "experiment_tag, sample_ordinal, bundle_no"


@_query("j32_a48_w15_weighted_belief", f"""{_R}, {_COMB}, {_bet(_BS, False, 'pe')}, wt as (select {_S}, round(avg(obs * disc), 9) as weight from r group by 1, 2),
x0 as (select experiment_tag, bundle_no, stage, sample_ordinal, bet_p, round(bet_p + 3.7e-13, 9) as v, greatest(coalesce(weight, 0), 0) as w0 from pe join (select {_S} from cb where usable) using ({_S}) left join wt using ({_S})),
x as (select *, case when sum(w0) over (partition by experiment_tag, bundle_no, stage) > 0 then w0 else 1 end as w from x0),
cu as (select *, row_number() over k as pos, sum(w) over k / sum(w) over (partition by experiment_tag, bundle_no, stage) as c from x window k as (partition by experiment_tag, bundle_no, stage order by v, w, sample_ordinal rows unbounded preceding)),
qu as (select experiment_tag, bundle_no, stage, {", ".join(f"max({{'pos': pos, 'v': v, 'c': c}}) filter (c <= {q}) as l{n}, min({{'pos': pos, 'v': v, 'c': c}}) filter (c > {q}) as h{n}" for q, n in ((0.1, "10"), (0.9, "90")))} from cu group by all),
me as (select experiment_tag, bundle_no, stage, sum(w * bet_p) / sum(w) as mean, count(distinct sample_ordinal) as rubrics, sum(w) as weight_sum from x group by all)
select experiment_tag, bundle_no, stage, n<mean>n as mean, rubrics, n<weight_sum>n as weight_sum,
 {", ".join(f"n<case when l{n} is null then h{n}.v when h{n} is null then l{n}.v else l{n}.v + ({q} - l{n}.c) / (h{n}.c - l{n}.c) * (h{n}.v - l{n}.v) end>n as q{n}" for q, n in ((0.1, "10"), (0.9, "90")))} from me join qu using (experiment_tag, bundle_no, stage)""", nudge=_NUDGE)
def _(spark, d):
    r = responses(spark, d)
    return reports.weighted_belief(r, reports.rubric_weights(r))


_DIV = f"""{_bet(_S, False, 'b')}, e1 as (select {_S}, stage, (bet_p + 1e-8) / sum(bet_p + 1e-8) over (partition by {_S}) as p, count(*) over (partition by {_S}) as sc from b),
jo as (select a.sample_ordinal, a.experiment_tag as left_tag, c.experiment_tag as right_tag, a.stage, a.p, c.p as q, (a.p + c.p) / 2 as m from e1 a join e1 c on a.sample_ordinal = c.sample_ordinal and a.stage = c.stage and a.sc = c.sc and a.experiment_tag < c.experiment_tag),
e2 as (select *, {", ".join(f"({v} + 1e-8) / sum({v} + 1e-8) over w as {v}2" for v in "pqm")} from jo window w as (partition by sample_ordinal, left_tag, right_tag)),
dv as (select sample_ordinal, left_tag, right_tag, (sum(p2 * ln(p2 / m2)) + sum(q2 * ln(q2 / m2))) / 2 as js, sum(abs(p - q)) / 2 as tv from e2 group by 1, 2, 3)"""


def _div(spark, d):
    return reports.divergences(belief.by_stage(belief.beliefs(responses(spark, d), geometry.SAMPLE), geometry.SAMPLE))


@_query("j29_m12_divergences", f"{_R}, {_DIV} select sample_ordinal, left_tag, right_tag, n<js>n as js, n<tv>n as tv from dv", nudge=_NUDGE)
def _(spark, d):
    return _div(spark, d)


@_query("a50_divergence_summary", f"{_R}, {_DIV} select left_tag, right_tag, count(*) as n, n<avg(js)>n as mean_js, n<quantile_cont(js, 0.5)>n as median_js, n<avg(tv)>n as mean_tv, n<quantile_cont(tv, 0.5)>n as median_tv from dv group by 1, 2", nudge=_NUDGE)
def _(spark, d):
    return reports.divergence_summary(_div(spark, d))


@_query("a50_largest_divergences", f"{_R}, {_DIV}, k as (select *, cast(row_number() over (partition by left_tag, right_tag order by round(js, 9) desc, sample_ordinal) as int) as place from dv) select sample_ordinal, left_tag, right_tag, n<js>n as js, n<tv>n as tv, place from k where place <= 3", nudge=_NUDGE)
def _(spark, d):
    return reports.largest_divergences(_div(spark, d))


@_query("w7_sample_z_scores", f"{_R}, {_SM} select {_S}, n<mean_expected_stage>n as mean_expected_stage, n<case when mean_expected_stage is not null then coalesce((mean_expected_stage - avg(mean_expected_stage) over w) / nullif(stddev_pop(mean_expected_stage) over w, 0), 0) end>n as z from sm window w as (partition by experiment_tag)")
def _(spark, d):
    s = geometry.sample_metrics(responses(spark, d)).select(*geometry.SAMPLE, "mean_expected_stage")
    return reports.z_scores(s, ["experiment_tag"], "mean_expected_stage")


_OUT = ["abstain_rate", "singleton_rate", "mean_subset_size", "mean_tbm_conflict", "mean_closed_world_conflict"]


def _zs(columns, source: str) -> str:
    return f"zl as (unpivot (select experiment_tag, {', '.join(f'cast({c} as double) as {c}' for c in columns)} from {source}) on {', '.join(columns)} into name metric value value), zz as (select *, coalesce((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 0) as z from zl window w as (partition by metric))"


@_query("w8_outliers", f"{_R}, {_SB}, {_EC}, {_zs(_OUT, 'ec')} select experiment_tag, metric, n<value>n as value, n<z>n as z from zz where abs(z) >= 1.5", nudge=_NUDGE)
def _(spark, d):
    return reports.outliers(_experiments(spark, d), _OUT)


@_query("k4_unstable_samples", f"{_R}, {_SM}, i as (select sample_ordinal, {' + '.join(f'coalesce(stddev_samp({m}), 0)' for m in geometry.INSTABLE[:4])} as instability from sm group by 1) select sample_ordinal, n<instability>n as instability from i order by round(instability, 9) desc, sample_ordinal limit 12")
def _(spark, d):
    s = geometry.sample_metrics(responses(spark, d)).withColumns({c: F.lit(None).cast("double") for c in _BELIEF})
    return geometry.sample_instability(s).select("sample_ordinal", "instability").orderBy(F.desc(F.round("instability", 9)), "sample_ordinal").limit(12)


@_query("k6_lowest_entropy", f"{_R}, {_STAGED}, mass as (select experiment_tag, scale_size, stage, sum(p) / count(*) as m from sp group by 1, 2, 3), g as (select experiment_tag, sum(case when m > 0 then -m * log2(m) else 0 end) / log2(max(scale_size)) as stage_entropy from mass group by 1) select experiment_tag, n<stage_entropy>n as stage_entropy from g order by stage_entropy limit 3")
def _(spark, d):
    return geometry.experiment_geometry(responses(spark, d)).select("experiment_tag", "stage_entropy").orderBy("stage_entropy").limit(3)


_FOUR = ("mean_agreement", "abstain_rate", "mean_subset_size", "mean_expected_stage")


def _certainty(spark, d):
    return contrasts.effects(_deltas(spark, d).where(F.col("endpoint").isin(*_FOUR)))


@_query("a12_scale_certainty_effects", f"{_R}, {_EFF} select contrast_id, endpoint, n, n<mean_delta>n as mean_delta, n<median_delta>n as median_delta, n<case when std_delta > 0 then mean_delta / std_delta end>n as dz from ef where endpoint in {_FOUR}")
def _(spark, d):
    return _certainty(spark, d).select("contrast_id", "endpoint", "n", "mean_delta", "median_delta", "dz")


_LOW = ["mid_scale_mass", "stage_entropy"]
_CAND = f"""{_SB}, {_EC}, {_zs(_OUT, 'ec')}, {_PAIRS}, {_EFF.split(_PAIRS + ", ", 1)[1]}, geo as (select experiment_tag, sum(case when stage > 1 and stage < scale_size then m else 0 end) as mid_scale_mass, sum(case when m > 0 then -m * log2(m) else 0 end) / log2(max(scale_size)) as stage_entropy from (select experiment_tag, scale_size, stage, sum(p) / count(*) as m from sp group by 1, 2, 3) group by 1),
{_zs(_LOW, 'geo').replace('zl ', 'yl ').replace('zz ', 'yy ').replace('from zl', 'from yl')}, ins as (select sample_ordinal, {' + '.join(f'coalesce(stddev_samp({m}), 0)' for m in geometry.INSTABLE[:4])} as score from sb group by 1),
ca as ((select 'family_effect' as finding_kind, contrast_id as subject, endpoint as detail, abs(mean_delta) as score from ef where endpoint in {contrasts.PRIMARY} order by round(abs(mean_delta), 9) desc, contrast_id, endpoint limit 12)
 union all select 'experiment_outlier', experiment_tag, metric, abs(z) from zz where abs(z) >= 1.5 union all select 'compression_outlier', experiment_tag, metric, abs(z) from yy where z <= -1.5
 union all (select 'sample_instability', concat('S', case when sample_ordinal < 10 then '0' else '' end, sample_ordinal::varchar), 'instability', score from ins order by round(score, 9) desc, sample_ordinal limit 10)
 union all (select 'scale_certainty', contrast_id, endpoint, abs(mean_delta) from ef where endpoint = 'mean_agreement' order by round(abs(mean_delta), 9) desc, contrast_id limit 4))"""


def _candidates(spark, d):
    s, deltas = _samples(spark, d), _deltas(spark, d)
    e = contrasts.effects(deltas)
    return reports.candidate_findings(e.where(F.col("endpoint").isin(*contrasts.PRIMARY)), _experiments(spark, d), geometry.experiment_geometry(responses(spark, d)), geometry.sample_instability(s), e)


@_query("k1_candidate_findings", f"{_R}, {_CAND} select finding_kind, subject, detail, n<score>n as score from ca", nudge=_NUDGE)
def _(spark, d):
    return _candidates(spark, d)


@_query("k3_descriptive_findings", f"{_R}, {_CAND} select finding_kind, subject, detail, n<score>n as rank_score from ca where finding_kind <> 'family_effect' order by round(score, 9) desc, finding_kind, subject, detail limit 25", nudge=_NUDGE)
def _(spark, d):
    return reports.descriptive_findings(_candidates(spark, d)).drop("score")


@_query("k5_u1_merged_findings", f"""{_R}, {_CAND}{_RES[len(_EFF):]}, de2 as (select 'descriptive' as finding_scope, concat('descriptive:', finding_kind, ':', subject) as finding_id, score as rank_score, detail from ca where finding_kind <> 'family_effect' order by round(score, 9) desc, finding_kind, subject, detail limit 25),
un as (select * from de2 union all select 'inferential', concat('inferential:', contrast_id, ':', endpoint), rank_score, '' from rk)
select finding_scope, finding_id, n<rank_score>n as rank_score, cast(row_number() over (order by finding_scope, round(rank_score + {_NUDGE}, 9) desc, finding_id, detail) as int) as place from un""", nudge=_NUDGE)
def _(spark, d):
    descriptive = reports.descriptive_findings(_candidates(spark, d)).withColumn("rank_score", F.col("rank_score") + _NUDGE)
    return reports.merged_findings(descriptive, contrasts.ranked_findings(_qvalues(spark, d)))


@_query("a16_j23_report_panel", f"""{_R}, {_POOL}, su as (select experiment_tag, method, count(*) as n, avg(expected_stage) as e, avg(top_p) as t from me group by 1, 2),
al as (select m.experiment_tag, m.method, avg(abs(m.expected_stage - b.expected_stage)) as ma, avg(m.expected_stage - b.expected_stage) as bi from me m join me b using ({_S}) where b.method = 'linear' and m.method <> 'linear' group by 1, 2),
pa as (select method, avg(ma) as ma, avg(bi) as bi from al group by 1) select method, cast(sum(n) as bigint) as n, n<avg(e)>n as mean_expected_stage, n<avg(t)>n as mean_top_p, n<max(pa.ma)>n as mean_absolute, n<max(pa.bi)>n as bias from su left join pa using (method) group by 1""", nudge=_NUDGE)
def _(spark, d):
    m = checkpointed(pools.methods_beside(responses(spark, d)))  # both tables rest on it
    return reports.report_panel(pools.method_summary(pools.sample_methods(m)), pools.method_alignment(m))


_WORDS = "select cast(p_partkey % 20 as bigint) as bundle_no, cast(p_partkey % 7 + 1 as int) as stage, min(concat(p_name, repeat(' more', cast(p_size % 5 as int)))) as text from {part} group by 1, 2"


_LENGTHS = f"""tx as ({_WORDS.format(part='part')}), wo as (select bundle_no, stage, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from tx), zw as (select bundle_no, stage, coalesce((words - avg(words) over w) / nullif(stddev_pop(words) over w, 0), 0) as z from wo window w as (partition by bundle_no)),
s2 as (select experiment_tag, bundle_no, mask, obs::double as obs, disc::double as disc, unnest(range(1, scale_size + 1)) as stage from r where mask <> 0),
lr as (select experiment_tag, bundle_no, obs, disc, ((mask & (1::bigint << (s2.stage - 1))) <> 0)::int::double as y, z from s2 left join zw using (bundle_no, stage))"""


def _p_sql(t: str, df: str) -> str:
    """The two-sided tail of the t distribution by Simpson's rule over the angle, for 40 degrees of freedom or more."""
    half = "(a / 2 - 0)"
    ratio = f"exp(ln({half}) / 2 - 1 / (8 * {half}) + 1 / (192 * {half} ** 3) - 1 / (640 * {half} ** 5))"
    weight = "(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"""list_transform([{{'a': ({df})::double, 'h': atan(abs({t}) / sqrt({df}))}}], lambda s: list_transform([s.a], lambda a: 1 - 2 * {ratio} / sqrt(pi()) * s.h / 6000
 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * pow(cos(i * s.h / 2000), a - 1))))[1])[1]"""


def _t_sql(df: str) -> str:
    z = NormalDist().inv_cdf(0.975)
    return f"({z} + {(z**3 + z) / 4} / ({df}) + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / ({df})::double ** 2 + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / ({df})::double ** 3)"


@_query("f18_j30_m10_length_bias", f"""{_R}, {_LENGTHS}, fi as (select experiment_tag, regr_slope(y, z) as b, regr_syy(y, z) as syy, regr_sxx(y, z) as sxx, regr_count(y, z) as m, count(*) as n from lr group by 1 having count(*) >= 10 and count(distinct y) > 1)
select experiment_tag, n<b>n as coef_stage_len_z, n<{_p_sql("b / sqrt((syy - b * b * sxx) / (m - 2) / sxx)", "m - 2")}>n as p_value, n as n_rows from fi""")
def _(spark, d):
    return reports.length_slopes(reports.length_bias(responses(spark, d), _words(spark, d)))


def _words(spark, d):
    return spark.sql(_WORDS, part=table(spark, d, "part")).select("bundle_no", "stage", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words"))


@_query("m11_length_bias_within_bundles", f"""{_R}, {_LENGTHS}, ok as (select * from lr where z is not null), ce as (select experiment_tag, {", ".join(f"{c} - avg({c}) over w as {c}" for c in ("y", "z", "obs"))}, y as raw, dense_rank() over (partition by experiment_tag order by bundle_no) as lv from ok window w as (partition by experiment_tag, bundle_no)),
su as (select experiment_tag, sum(z * obs) / sum(obs * obs) as bz, sum(y * obs) / sum(obs * obs) as by_ from ce group by 1), re as (select ce.experiment_tag, raw, lv, y - by_ * obs as y, z - bz * obs as z from ce join su using (experiment_tag)),
fi as (select experiment_tag, sum(z * y) / sum(z * z) as b, sum(z * z) as zz, sum(y * y) as yy, count(*) as n, count(*) - max(lv) - 2 as df, var_pop(raw) * count(*) as tss from re group by 1), se as (select *, sqrt((yy - b * b * zz) / df / zz) as e from fi)
select experiment_tag, 'length_z' as term, n<b>n as coef, n<e>n as stderr, n<{_p_sql("b / e", "df")}>n as p_value, n<b - {_t_sql("df")} * e>n as conf_low, n<b + {_t_sql("df")} * e>n as conf_high, n<1 - (yy - b * b * zz) / tss>n as r_squared, n as n_obs, df as df_resid from se""")
def _(spark, d):
    rows = reports.length_bias(responses(spark, d), _words(spark, d))
    return least_squares(rows, "experiment_tag", "selected", ["length_z", "obs", "disc"], ["bundle_no"]).where("term = 'length_z'")


def _additive_sql(cells: str, rounds: int) -> str:
    """Effects of ``a`` and ``b`` on x and y in each family, by that many rounds of taking each factor's means of what the other leaves."""
    out = f"fa0 as (select k, a, 0.0::double as x, 0.0::double as y from {cells} group by 1, 2)"
    for i in range(1, rounds + 1):
        last = lambda side, j: f"f{side}{j}"
        for side, other, j in (("b", "a", i - 1), ("a", "b", i)):
            out += f""", f{side}{i} as materialized (select k, {side}, sum(c.x - c.n * o.x) / sum(c.n) as x, sum(c.y - c.n * o.y) / sum(c.n) as y from {cells} c join {last(other, j)} o using (k, {other}) group by 1, 2)"""
    return out


@_query("m9_m11_fixed_effects", f"""{_R}, rr as (select split_part(experiment_tag, '_', 2) as k, bundle_no as a, sample_ordinal as b, scale_size::double as x, agreement::double as y from r), c as materialized (select k, a, b, count(*) as n, sum(x) as x, sum(y) as y from rr group by 1, 2, 3),
{_additive_sql("c", 24)}, rs as (select rr.k, rr.y as raw, rr.x - fa24.x - fb24.x as x, rr.y - fa24.y - fb24.y as y from rr join fa24 using (k, a) join fb24 using (k, b)),
fi as (select k, sum(x * y) / sum(x * x) as b, sum(x * x) as xx, sum(y * y) as yy, var_pop(raw) * count(*) as tss, count(*) as n, count(*) - (select count(*) from fa0 where fa0.k = rs.k) - (select count(*) from fb1 where fb1.k = rs.k) as df from rs group by 1), se as (select *, sqrt((yy - b * b * xx) / df / xx) as e from fi)
select k as family_code, 'scale_size' as term, n<b>n as coef, n<e>n as stderr, n<{_p_sql("b / e", "df")}>n as p_value, n<b - {_t_sql("df")} * e>n as conf_low, n<b + {_t_sql("df")} * e>n as conf_high, n<1 - (yy - b * b * xx) / tss>n as r_squared, n as n_obs, df as df_resid from se""")
def _(spark, d):
    rows = responses(spark, d).select(family(F.col("experiment_tag")).alias("family_code"), "bundle_no", "sample_ordinal", "scale_size", "agreement")
    return least_squares(rows, "family_code", "agreement", ["scale_size"], ["bundle_no", "sample_ordinal"])


_VEC = "select concat('v3_', case when vec_id % 2 = 0 then 'a1_' else 'b1_' end, case (vec_id // 2) % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end) as experiment_tag, vec_id // 6 as sample_ordinal, embedding as vector from embeddings where embedding is not null"


@_query("m14_j24_j25_pair_cosine", f"""with v as ({_VEC}), ct as (select concat('toggle_', x) as contrast_id, concat('v3_a1_', x) as baseline_tag, concat('v3_b1_', x) as variant_tag from (select unnest(['alpha', 'beta', 'gamma']) as x)),
u as (select experiment_tag, sample_ordinal, unnest(vector)::double as x, unnest(range(1, len(vector) + 1)) as i from v), p as (select contrast_id, a.sample_ordinal, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) as c from ct join u a on a.experiment_tag = baseline_tag join u b on b.experiment_tag = variant_tag and a.sample_ordinal = b.sample_ordinal and a.i = b.i group by 1, 2)
select contrast_id, cast(sample_ordinal as bigint) as sample_ordinal, n<c>n as cosine from p union all select contrast_id, -1, n<avg(c)>n from p group by 1""")
def _(spark, d):
    v = table(spark, d, "embeddings").where("embedding is not null")
    x = F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (F.floor(F.col("vec_id") / 2) % 3 + 1).cast("int"))
    v = v.select(F.concat(F.lit("v3_"), F.when(F.col("vec_id") % 2 == 0, "a1_").otherwise("b1_"), x).alias("experiment_tag"), F.floor(F.col("vec_id") / 6).alias("sample_ordinal"), F.col("embedding").alias("vector"))
    return reports.pair_cosine(v, contrasts.paired_families(v))


_TAGS = "select distinct concat(case when p_size % 3 = 0 then 'v3_1_' when p_size % 3 = 1 then 'v3_' else '' end, case when p_size % 5 < 4 then concat('a', (p_size % 9)::varchar, '_') else '' end, replace(lower(p_brand), '#', '_')) as tag from part"


@_query("p11_y3_family_tags", f"""with t as ({_TAGS}), f as (select tag, case when starts_with(tag, 'v3_1_') then split_part(tag, '_', 3) else split_part(tag, '_', 2) end as code from t)
select tag, code as family_code, concat(code, '_', case code {" ".join(f"when '{k}' then '{v}'" for k, v in __import__("assayer.functions.verdicts", fromlist=["FAMILIES"]).FAMILIES.items())} else code end) as family_slug,
 case when starts_with(tag, 'v3_1_') and len(string_split(tag, '_')) > 3 then array_to_string(string_split(tag, '_')[4:], '_') when len(string_split(tag, '_')) > 2 then array_to_string(string_split(tag, '_')[3:], '_') else tag end as variant from f""")
def _(spark, d):
    size = F.col("p_size")
    tag = F.concat(F.when(size % 3 == 0, "v3_1_").when(size % 3 == 1, "v3_").otherwise(""), F.when(size % 5 < 4, F.concat(F.lit("a"), (size % 9).cast("string"), F.lit("_"))).otherwise(""), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
    t = table(spark, d, "part").select(tag.alias("tag")).distinct()
    return t.select("tag", family(F.col("tag")).alias("family_code"), family_slug(F.col("tag")).alias("family_slug"), variant(F.col("tag")).alias("variant"))


@_query("a23_a45_report_counts", f"{_R} select 'responses' as dataset, count(*) as n from r union all select 'samples', count(*) from (select distinct {_S} from r) union all select 'bundles', count(*) from (select distinct experiment_tag, bundle_no from r) union all select 'experiments', count(distinct experiment_tag) from r")
def _(spark, d):
    r = responses(spark, d)
    counts = r.agg(F.count("*").alias("responses"), F.countDistinct(*geometry.SAMPLE).alias("samples"), F.countDistinct("experiment_tag", "bundle_no").alias("bundles"), F.countDistinct("experiment_tag").alias("experiments"))
    return counts.select(F.explode(F.create_map(*(x for c in counts.columns for x in (F.lit(c), F.col(c))))).alias("dataset", "n"))


_FOCUS = "select *, concat('v3_', case when vec_id % 2 = 0 then 'a1_' else 'b1_' end, case (vec_id // 2) % 4 when 0 then 'abstain_true' when 1 then 'control' when 2 then 'scale_9' else 'plain' end) as tag from embeddings where embedding is not null"


@_query("j27_p13_focus_similarity", f"""with v as ({_FOCUS}), m as (select tag, i, avg(x) as x from (select tag, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from v) group by 1, 2),
c as (select a.tag as ta, b.tag as tb, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) as c from m a join m b on a.i = b.i group by 1, 2),
e as (select tag, case when tag like '%control' then 'other' else concat('judge-', tag[4:5]) end as model, concat(tag[4:5], '_', case tag[4:5] {" ".join(f"when '{k}' then '{v}'" for k, v in FAMILIES.items())} else tag[4:5] end) as family,
 concat(tag[4:5], '|J', case when tag like '%abstain_true' then '|A+' when tag like '%scale_9' then '|s9' when tag like '%b1_plain' then '|l3' else '' end) as label from (select distinct tag from v))
select ta as experiment_a, tb as experiment_b, n<c>n as cosine, a.model as model_a, b.model as model_b, a.family as family_a, b.family as family_b, a.label as display_label_a, b.label as display_label_b
from c join e a on a.tag = ta join e b on b.tag = tb where a.model <> 'other' and b.model <> 'other'""")
def _(spark, d):
    v, k = table(spark, d, "embeddings").where("embedding is not null"), F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("abstain_true", "control", "scale_9", "plain"))), (F.floor(k / 2) % 4 + 1).cast("int"))
    v = v.select(F.concat(F.lit("v3_"), F.when(k % 2 == 0, "a1_").otherwise("b1_"), kind).alias("experiment_tag"), "embedding")
    tag = F.col("experiment_tag")
    model = F.when(tag.endswith("control"), "other").otherwise(F.concat(F.lit("judge-"), family(tag)))
    view = F.when(tag.endswith("b1_plain"), "l3_abstracted").otherwise("l0_raw")
    experiments = v.select(tag).distinct().select(tag, model.alias("model_id"), F.lit("J").alias("model_short"), view.alias("evidence_view"))
    similarity = text.centroid_cosine(v, "experiment_tag", "embedding").withColumnsRenamed({"left_group": "experiment_a", "right_group": "experiment_b"})
    return reports.focus_similarity(similarity, experiments, ["judge-a1", "judge-b1"])
