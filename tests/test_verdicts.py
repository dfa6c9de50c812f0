import pytest
from pyspark.sql import functions as F

from assayer.functions.verdicts import bucket, expected_stage, label, mask_of
from assayer.operators.resampling import resampled
from assayer.operators import belief, bundles, contrasts, geometry, ops, pools, text
from assayer.sources.snapshots import SnapshotStore, batch_results

SCHEMA = "response_id string, experiment_tag string, sample_ordinal long, scale_size int, mask long, bundle_no long, agreement double, obs double, disc double"


def frame(spark, rows):
    return spark.createDataFrame([(str(i), tag, s, 4, mask, 0, a, 1.0, 1.0) for i, (tag, s, mask, a) in enumerate(rows)], SCHEMA)


def test_verdict_functions(spark):
    rows = spark.createDataFrame([([2],), ([3, 2, 3],), ([1, 3, 4],), ([1, 4],), (None,)], "stages array<int>").withColumn("m", mask_of(F.col("stages"), F.lit(4)))
    got = [tuple(r) for r in rows.select(label(F.col("m"), F.lit(4)), bucket(F.col("m"), F.lit(4)), expected_stage(F.col("m"), F.lit(4))).collect()]
    assert got == [("[2]", "singleton", 2.0), ("[2,3]", "adjacent_subset", 2.5), ("[1,3,4]", "broad_subset", 8 / 3), ("[1,4]", "non_adjacent_subset", 2.5), ("ABSTAIN", "abstain", None)]
    with pytest.raises(Exception, match="outside the scale"):
        spark.createDataFrame([([5],)], "s array<int>").select(mask_of(F.col("s"), F.lit(4))).collect()


def test_geometry_of_four_verdicts(spark):
    r = frame(spark, [("t", 1, 0b0010, 1.0), ("t", 1, 0b0110, 1.0), ("t", 1, 0b1101, 1.0), ("t", 1, 0, 1.0)])
    m = geometry.experiment_metrics(r).first()
    assert m.abstain_rate == 0.25 and abs(m.singleton_rate - 1 / 3) < 1e-12 and m.mean_subset_size == 2.0
    g = geometry.experiment_geometry(r).first()
    assert abs(g.abstain_mass - 0.25) < 1e-12 and abs(g.mass_stage_2 - 1.5 / 4) < 1e-12 and g.mass_stage_9 == 0


def test_pools_and_conflict(spark):
    r = frame(spark, [("t", 1, 0b0001, 0.8), ("t", 1, 0b1000, 0.2), ("u", 1, 0b0001, 1.0), ("u", 1, 0b1000, 1.0), ("v", 1, 0, 0.9), ("v", 1, 0b0010, 0.8)])
    p = {(x.experiment_tag, x.method, x.stage): x for x in pools.pooled(r).collect()}
    assert [round(p["t", "linear", s].p, 9) for s in (1, 2, 3, 4)] == [0.8, 0, 0, 0.2]
    assert p["u", "tbm", 1].conflict >= 0.9999 and p["u", "tbm", 1].p == 0
    assert abs(p["v", "closed_world", 1].conflict) < 1e-12 and max((1, 2, 3, 4), key=lambda s: p["v", "closed_world", s].p) == 2
    for (tag, method), total in {(k[0], k[1]): sum(x.p for j, x in p.items() if j[:2] == k[:2]) for k in p}.items():
        assert abs(total - 1) < 1e-9 or total == 0, (tag, method)
    q = belief.commonalities(r.where("experiment_tag = 't'"), ["experiment_tag"])
    assert abs(sum(x.mass for x in belief.masses(q, ["experiment_tag"]).collect()) - 1) < 1e-12


def test_contrasts_effects_and_q_values(spark):
    r = frame(spark, [(f"v3_{arm}_x", s, mask, 1.0) for s in range(1, 9) for arm, mask in (("a1", 0b0001), ("b1", 0b0100))])
    samples = geometry.sample_metrics(r)
    c = contrasts.paired_families(samples)
    matched = contrasts.matching(samples, c)
    assert contrasts.matching_validation(matched).first().asDict() == {"contrast_id": "toggle_x", "n_baseline": 8, "n_variant": 8, "n_matched": 8, "fully_matched": True, "note": contrasts.NOTES[False][0]}
    deltas = contrasts.pair_deltas(samples, c, matched)
    e = {x.endpoint: x for x in contrasts.effects(deltas).collect()}["mean_expected_stage"]
    assert e.mean_delta == 2.0 and e.n == 8
    s = {x.endpoint: x for x in resampled(deltas).collect()}
    assert s["mean_expected_stage"].ci_low == 2.0 and s["mean_expected_stage"].p_value < 0.03 and s["mean_agreement"].p_value == 1.0
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5), ("d", None)], "endpoint string, p_value double")
    assert {x.endpoint: x.q_value and round(x.q_value, 9) for x in contrasts.q_values(p).collect()} == {"a": 0.03, "b": 0.03, "c": 0.5, "d": None}


def test_parsers(spark):
    raws = ["why\nVERDICT: A", "x\n- VERDICT: VERDICT: `B, d.`", "VERDICT: A\nlater\nverdict: abstain", "none", "VERDICT: k9x", "EXPERT_AGREEMENT: 0.4\nEXPERT_AGREEMENT: 1.5"]
    df = spark.createDataFrame([*enumerate(raws)], "i int, raw string")
    raw, mapping = F.col("raw"), F.create_map(F.lit("k9x"), F.lit(3), F.lit("A"), F.lit(1))
    got = {r.i: r for r in df.select("i", text.letters_to_stages(raw).alias("s"), text.mapped_stages(raw, mapping).alias("m"), text.agreement(raw).alias("a"), text.reasoning(raw).alias("why")).collect()}
    assert [got[i].s for i in range(6)] == [[1], [2, 4], [], None, None, None]
    assert got[0].m == [1] and got[4].m == [3] and got[1].m is None and got[5].a == 1.0 and got[0].a is None and got[0].why == "why"
    c = spark.createDataFrame([("a; b (x; y); and c",), ("p, q, r",), (None,)], "t string").select(text.criteria("t").alias("c")).collect()
    assert [x.c for x in c] == [["a", "b (x; y)", "c"], ["p", "q", "r"], None]
    rubric = spark.createDataFrame([("RUBRIC:\n1) Low :: a; b; c\n 2) High one :: d",)], "t string").select(text.rubric_stages(F.col("t")).alias("s")).first().s
    assert [(x.stage_number, x.label, x.criteria) for x in rubric] == [(1, "Low", "a; b; c"), (2, "High one", "d")]


def test_seeded_order_and_bundles(spark):
    assert sorted(bundles.shuffled(list(range(50)), 9)) == list(range(50)) != bundles.shuffled(list(range(50)), 9)
    assert all(-(2**31) <= s < 2**31 for s in bundles.seeds(5, 100)) and bundles.seeds(5, 3) == bundles.seeds(5, 9)[:3]
    rows = spark.createDataFrame([("p", "w", i) for i in range(8)], "pool string, win string, item long")
    at = bundles.seeded_shuffle(rows, "pool", "item", 3)
    out = bundles.bundle_rows(bundles.chunked(at, "pool", "at", 3), "pool", "item").orderBy("bundle").collect()
    assert [r["size"] for r in out] == [3, 3, 2] and sorted("|".join(r.signature for r in out).split("|")) == [str(i) for i in range(8)]
    assert bundles.run_fan_out(rows, 2, 1).count() == 16


def test_ops(spark):
    messages = ["", "Quota exceeded", "Failed to parse verdict", "Request TIMEOUT", "429", "other", None]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in messages], "m string").select(ops.error_class(F.col("m"))).collect()]
    assert got == ["unknown", "quota_exhausted", "parse_error", "timeout", "rate_limit", "unknown", "unknown"]
    rows = [("a:1:g", i, s) for i, s in enumerate(["error", "error", "error"])] + [("b:1:g", 4, "error"), ("b:1:g", 5, "success"), ("c:1:g", 6, "error"), ("d:1:g", 7, "pending")]
    req = spark.createDataFrame(rows, "custom_key string, request_id long, status string").withColumn("ts", F.timestamp_seconds("request_id"))
    states = ops.target_states(req)
    assert {r.custom_key[0]: r.resolution for r in states.collect()} == {"a": "exhausted", "b": "succeeded", "c": "retryable", "d": "pending"}
    assert ops.stage_progress(states).first().asDict() == {"stage": "g", "completed": 1, "failed": 1, "pending": 2, "total": 4, "status": "running"}
    events = spark.createDataFrame([(1, i, "view") for i in range(35)], "user_id long, event_id long, event_type string")
    kept = sorted(r.event_id for r in ops.last_events(events).collect())
    assert len(kept) == 32 and kept[0] == 3


def test_snapshot_store_and_batch_lines(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.tags().count() == 0
    first = store.export("t", "run1", {"responses": spark.range(3)})
    assert store.export("t", "run1", {"responses": spark.range(9)}) == first
    second = store.export("t", "run2", {"responses": spark.range(2).withColumn("extra", F.lit(1))})
    assert store.latest().first().snapshot_id == second and store.load("responses", [first]).count() == 3 and store.load("responses").count() == 5
    lines = ['{"custom_id":"a","response":{"status_code":200,"body":{"choices":[{"message":{"content":"ok"}}]}}}', '{"custom_id":"b","response":{"status_code":500}}', '{"custom_id":"c","error":{"message":"bad"}}']
    assert [(r.custom_id, r.status) for r in batch_results(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == [("a", "completed"), ("b", "error"), ("c", "error")]
