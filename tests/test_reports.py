"""Hand-made results of the report, campaign and prompt operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions.verdicts import bucket_of_label, family_slug, variant
from assayer.operators import belief, campaign, contrasts, ops, prompts, reports, text


def test_error_classes_in_their_order(spark):
    said = {
        "Insufficient credits": "quota_exhausted", "Could not parse": "parse_error", "Expected 4 stages": "parse_error", "Rubric is odd": "unknown", "request TIMED OUT": "timeout", "deadline exceeded": "timeout",
        "please try again later": "temporary_unavailable", "Temporarily unavailable": "temporary_unavailable", "HTTP 429": "rate_limit", "too many bytes read": "orchestrator_error", "provider refused": "api_error", "": "unknown",
    }
    got = spark.createDataFrame([(m,) for m in said], "m string").select(ops.error_class(F.col("m"))).collect()
    assert [r[0] for r in got] == list(said.values())


def test_verdict_lines_begin_a_line(spark):
    raws = ["I say VERDICT: A", "x\nVERDICT: ABSTAIN\r", "x\n- VERDICT: VERDICT: `b, C.`", "x\nverdict: \"D\";", "why\nVERDICT: A\nmore\nVERDICT: C"]
    raw = F.col("raw")
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(text.letters_to_stages(raw), text.single_verdict(raw), text.reasoning(raw)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ([], 0, "x"), ([2, 3], 2, "x"), ([4], 4, "x"), ([3], 3, "why\nVERDICT: A\nmore")]
    mapping = F.create_map(F.lit("aB"), F.lit(3))
    got = spark.createDataFrame([("VERDICT: aB",), ("VERDICT: AB",)], "raw string").select(text.single_verdict(raw, mapping)).collect()
    assert [r[0] for r in got] == [3, None]


def test_criteria(spark):
    cases = {"a; b; And c": ["a", "b", "c"], "a, b, c": ["a", "b", "c"], "a (x; y); b": ["a (x; y)", "b"], "a, b": ["a, b"], "a; b, c": ["a", "b", "c"], "": []}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select(text.criteria(F.col("c"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_tags_and_labels(spark):
    tags = spark.createDataFrame([("v3_a1_x_y",), ("v3_1_a3_z",), ("v3_zz",), ("lone",)], "t string")
    got = [tuple(r) for r in tags.select(family_slug(F.col("t")), variant(F.col("t"))).collect()]
    assert got == [("a1_abstain_toggle", "x_y"), ("a3_scale_size", "z"), ("zz_zz", "v3_zz"), ("misc_misc", "lone")]
    labels = spark.createDataFrame([("[1,2]",), ("[3,1]",), ("[1,2,4]",), ("[2]",), ("ABSTAIN",), (None,)], "l string")
    assert [r[0] for r in labels.select(bucket_of_label(F.col("l"))).collect()] == ["adjacent_subset", "non_adjacent_subset", "broad_subset", "singleton", "abstain", "abstain"]


def test_weighted_quantiles_keep_every_row_as_a_point(spark):
    sets = {
        "plain": [(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "ties": [(0.2, 1.0), (0.5, 3.0), (0.5, 1.0), (0.9, 1.0)], "zeros": [(1.0, 0.0), (2.0, 2.0), (4.0, 0.0), (5.0, 1.0)],
        "none": [(1.0, 0.0), (2.0, 0.0), (7.0, 0.0), (7.0, 0.0)], "one": [(3.0, 2.0)], None: [(1.0, 1.0), (4.0, 1.0)],
    }
    rows = [(k, v, w) for k, s in sets.items() for v, w in s] + [("plain", None, 1.0), ("plain", 9.0, None), ("plain", float("nan"), 1.0), ("none", float("inf"), 5.0)]
    got = {r.k: r for r in reports.weighted_quantiles(spark.createDataFrame(rows, "k string, x double, w double"), ["k"], "x", "w", (0.1, 0.25, 0.6, 1.0)).collect()}
    for k, points in sets.items():
        v, w = (np.array(x) for x in zip(*sorted(points), strict=True))
        for q in (0.1, 0.25, 0.6, 1.0):
            want = np.interp(q, np.cumsum(w) / w.sum(), v) if w.sum() > 0 else np.quantile(v, q)
            assert got[k][f"q{round(q * 100)}"] == pytest.approx(want), (k, q)
    assert got["ties"].q25 == pytest.approx(0.35)


def test_abstentions_stay_out_of_length_bias(spark):
    r = spark.createDataFrame([("e", 1, 2, 3, 0.5, 0.5), ("e", 1, 0, 3, 0.5, 0.5)], "experiment_tag string, bundle_no int, mask long, scale_size int, obs double, disc double")
    words = spark.createDataFrame([(1, s, 10 * s) for s in (1, 2, 3)], "bundle_no int, stage int, words int")
    rows = reports.length_bias(r, words)
    assert sorted((x.stage, x.selected, round(x.length_z, 4)) for x in rows.collect()) == [(1, 0.0, -1.2247), (2, 1.0, 0.0), (3, 0.0, 1.2247)]
    assert reports.length_slopes(rows).count() == 0
    many = reports.length_slopes(rows.unionByName(rows).unionByName(rows).unionByName(rows)).collect()
    assert [(x.n_rows, round(x.coef_stage_len_z, 9), round(x.p_value, 9)) for x in many] == [(12, 0.0, 1.0)]


def test_support_of_a_single_verdict(spark):
    r = spark.createDataFrame([("k", 3, 1, 0.8, 1.0, 1.0)], "k string, scale_size int, mask long, agreement double, obs double, disc double")
    got = {x.stage: (x.bel, x.pl, x.bet_p) for x in belief.support(belief.commonalities(r, ["k"]), ["k"]).collect()}
    assert got[1] == pytest.approx((0.8, 1.0, 0.8 + 0.2 / 3)) and got[2] == pytest.approx((0.0, 0.2, 0.2 / 3))
    total = belief.masses(belief.commonalities(r, ["k"]), ["k"]).agg(F.sum("mass")).first()[0]
    assert total == pytest.approx(1.0)


def test_null_p_values_and_single_pairs(spark):
    rows = spark.createDataFrame([("g", "a", 0.01), ("g", "b", None), ("g", "c", 0.04)], "g string, endpoint string, p_value double")
    got = {r.endpoint: (r.q_value, r.is_significant_fdr_05) for r in contrasts.q_values(rows, keys=("g",)).collect()}
    assert got == {"a": (0.02, True), "b": (None, False), "c": (0.04, True)}
    one = spark.createDataFrame([("c", 1, "e", 0.0, 1.0, 1.0)], "contrast_id string, sample_ordinal int, endpoint string, baseline double, variant double, delta double")
    e = contrasts.effects(one).first()
    assert (e.std_delta, e.dz, e.positive_share) == (0.0, None, 1.0)


def test_stored_results_and_late_attempts_settle_a_target(spark):
    rows = [("a", 1, 1, "error", 3, False), ("b", 2, 1, "error", 1, False), ("b", 3, 2, "error", 2, False), ("c", 4, 1, "error", 3, True), ("d", 5, 1, "error", None, False)]
    df = spark.createDataFrame(rows, "custom_key string, request_id long, ts int, status string, attempt_index int, artifact boolean")
    got = {r.custom_key: r.resolution for r in ops.target_states(df).collect()}
    assert got == {"a": "exhausted", "b": "retryable", "c": "succeeded", "d": "retryable"}


def test_superseding_and_views(spark):
    rows = [("k", 1, 1, "running", "r"), ("k", 2, 2, "error", "r"), ("k", 3, 3, "running", ""), ("k", 4, 0, "running", "r"), ("z", 5, 1, "running", "r")]
    b = spark.createDataFrame(rows, "key string, batch_id long, created int, status string, ref string")
    assert {r.batch_id: r.superseded_by for r in campaign.superseding(b, ("running",)).collect()} == {1: 4, 2: 1, 3: 1, 4: 1}
    e = spark.createDataFrame([(3, "raw", "one", None, None), (2, "raw", None, None, "three")], "l int, a string, b string, c string, d string")
    views = [campaign.evidence_view(F.col("l"), [F.col(c) for c in "abcd"], cascade) for cascade in (True, False)]
    assert [tuple(r) for r in e.select(*views).collect()] == [("one", "raw"), ("raw", "raw")]


def test_fnv_known_answers(spark):
    # Published values of the 32-bit FNV-1a hash.
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string")
    assert [r[0] for r in df.select(prompts.fnv1a(F.col("t"))).collect()] == ["fnv1a:811c9dc5", "fnv1a:e40c292c", "fnv1a:bf9cf968"]


def test_a_scale_beyond_the_columns_is_an_error(spark):
    from assayer.operators import geometry

    r = spark.createDataFrame([("v3_a1_x", 1, 10, 512)], "experiment_tag string, sample_ordinal long, scale_size int, mask long")
    assert geometry.experiment_geometry(r, stages=10).first().mass_stage_10 == 1.0
    with pytest.raises(Exception, match="more stages than columns"):
        geometry.experiment_geometry(r).collect()


def test_focus_labels_and_similarity(spark):
    rows = [("v3_a1_x", "m", "M", None), ("v3_1_b2_abstain_false_scale_9", "m", "M", "l3_abstracted"), ("v3_c3_y", "k", "K", "l3_abstracted"), ("v3_d4_z", "other", "O", None)]
    experiments = spark.createDataFrame(rows, "experiment_tag string, model_id string, model_short string, evidence_view string")
    tags = [r[0] for r in rows]
    pairs = spark.createDataFrame([(a, b, 0.5) for a in tags for b in tags] + [(None, tags[0], 0.5)], "experiment_a string, experiment_b string, cosine double")
    got = reports.focus_similarity(pairs, experiments, ["m", "k"]).collect()
    assert len(got) == 9 and {(r.experiment_a, r.display_label_a) for r in got} == {(tags[0], "a1|M"), (tags[1], "b2|M|A-"), (tags[2], "c3|K|l3")}
