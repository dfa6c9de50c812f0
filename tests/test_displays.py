import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import belief, bundles, campaign, prompts, text

M = 0xFFFFFFFF


def label(seed, index):
    draw = bundles.uniform(((seed & M) * 2654435761 & M) ^ ((index + 1) * 2246822519 & M))
    letters = string.digits + string.ascii_lowercase + string.ascii_uppercase
    return "".join(letters[math.floor(draw() * 62)] for _ in range(6))


def test_opaque_labels_and_seeded_order(spark):
    cases = [(s, n) for s in (0, 1, -5, 2**31 - 1, -(2**31), 123456789) for n in (1, 3, 9)]
    df = spark.createDataFrame(cases, "seed long, n int")
    mapping = prompts.label_mapping(F.col("seed"), F.col("n"), F.lit(True))
    items = F.transform(F.sequence(F.lit(1), "n"), lambda i: i.cast("string"))
    got = df.select("seed", "n", mapping.alias("m"), prompts.tokens_of(mapping, F.col("n")).alias("t"), prompts.seeded_order(items, F.col("seed")).alias("o"), prompts.seeded_order(items, F.lit(None).cast("long")).alias("same")).collect()
    for r in got:
        assert r.t == [label(r.seed, i) for i in range(r.n)] and r.m == {t: i + 1 for i, t in enumerate(r.t)}
        assert r.o == bundles.shuffled([str(i + 1) for i in range(r.n)], r.seed) and r.same == [str(i + 1) for i in range(r.n)]


def test_a_taken_label_is_drawn_anew(spark, monkeypatch):
    monkeypatch.setattr(prompts, "ALPHABET", "ab")
    monkeypatch.setattr(prompts, "LABEL_LENGTH", 2)
    got = [r.t for r in spark.range(30).select(prompts.opaque_labels(F.col("id"), F.lit(2)).alias("t")).collect()]
    assert all(len(t) == 2 and set("".join(t)) <= set("ab") for t in got) and sum(t[0] == t[1] for t in got) <= 1


def test_displays(spark):
    df = spark.createDataFrame([(1,)], "i int")
    stages = F.array(*(F.struct(F.lit(n).alias("label"), F.array(*map(F.lit, c)).alias("criteria")) for n, c in (("Low", ["a", "b"]), ("High", ["c"]))))
    plain, hidden = prompts.displayed_rubric(stages, prompts.letters(F.lit(2))), prompts.displayed_rubric(stages, F.array(F.lit("x1")), hide_labels=True)
    r = df.select(plain.alias("p"), hidden.alias("h"), prompts.displayed_rubric(stages, prompts.letters(F.lit(2)), F.lit(4)).alias("o")).first()
    assert r.p == ['A: "Low" - Criteria: a; b', 'B: "High" - Criteria: c'] and r.h == ["x1: Criteria: a; b", "B: Criteria: c"] and r.o == bundles.shuffled(r.p, 4)
    summary = lambda v: prompts.verdict_summary(v, F.array(F.lit("q"), F.lit("r")))
    r = df.select(summary(F.array(*map(F.lit, (2, 1, 2, 3, 0)))).alias("a"), summary(F.lit(None).cast("array<int>")).alias("b")).first()
    assert (r.a.status, r.a.selected_identifiers, r.b.status, r.b.selected_identifiers) == ("scored", ["q", "r"], "abstain", [])
    items = spark.createDataFrame([("b", 2, "raw2", None, "neutral"), ("b", 1, "raw1", "clean", None), ("n", 1, None, None, None)], "k string, at int, l0 string, l1 string, l2 string")
    got = {r.k: r for r in prompts.rendered_evidence(items, "k", "at", ["l0", "l1", "l2"]).collect()}
    assert got["b"].l0 == "EVIDENCE 1\nraw1\n\nEVIDENCE 2\nraw2" and got["b"].l1 == "EVIDENCE 1\nclean\n\nEVIDENCE 2\nraw2" and got["b"].l2 == "EVIDENCE 1\nclean\n\nEVIDENCE 2\nneutral" and got["n"].l0 == "EVIDENCE 1\n"


def test_keys_and_statuses(spark):
    keys = ["sample:1:rubric_gen", "evidence:2:l1:more", "run:3:score", "sample::score", "sample:4:", "sample", None]
    got = [r.k for r in spark.createDataFrame([(k,) for k in keys], "k string").select(campaign.key_parts(F.col("k")).alias("k")).collect()]
    assert [k and tuple(k) for k in got] == [("sample", "1", "rubric_gen"), ("evidence", "2", "l1"), None, None, None, None, None]
    states = ["in_progress", "Cancelling", "completed", "expired", "what", "", None]
    got = [tuple(r.s) for r in spark.createDataFrame([(s,) for s in states], "s string").select(campaign.batch_status(F.col("s")).alias("s")).collect()]
    assert got == [("running", None), ("running", None), ("completed", None), ("error", "batch_expired"), ("error", "batch_unknown_status:what"), ("error", "batch_missing_status"), ("error", "batch_missing_status")]


def test_campaign_states(spark):
    run = lambda c, status, **x: (c, x.get("present", True), status, x.get("failed", False), x.get("stage", "score_critic"), x.get("done", 5), 5)
    rows = [
        run("clean", None), run("done", "completed"), run("done", "completed"), run("gate", "paused"), run("gate", "paused"), run("early", "paused", stage="score_gen"), run("short", "paused", done=4),
        run("half", "completed"), run("half", None), run("failed", "completed", failed=True), run("gone", "completed"), run("gone", None, present=False), run("cut", "canceled"), run("slow", "running"), run("odd", "running"), run("spoilt", "running"),
    ]
    stuck = [("slow", "retryable_no_transport"), ("slow", "scheduler_not_running"), ("odd", "retryable_no_transport"), ("odd", "other"), ("spoilt", "batch_missing_ref"), ("done", "other")]
    e = spark.createDataFrame(rows, "c string, present boolean, run_status string, has_failures boolean, current_stage string, stage_done int, target_count int")
    got = {r.c: r.campaign_state for r in campaign.campaign_state(e, spark.createDataFrame(stuck, "c string, reason string"), "c", "score_critic").collect()}
    invalid, going = "scientifically_invalid", "healthy_progressing"
    assert got == {
        "clean": "preflight_clean", "done": "complete", "gate": "complete", "early": going, "short": going, "half": going, "failed": invalid, "gone": invalid, "cut": invalid,
        "slow": "stalled_recoverable", "odd": "stalled_unknown", "spoilt": invalid,
    }


def test_masses_by_butterflies(spark):
    rng = np.random.default_rng(1)
    n = 4
    m = rng.random(1 << n)
    q = [float(sum(m[b] for b in range(1 << n) if b & a == a)) for a in range(1 << n)]
    df = spark.createDataFrame([("k", n, m.tolist(), q)], "k string, scale_size int, m array<double>, q array<double>")
    r = df.select(belief.zeta(F.col("m"), F.col("scale_size")).alias("q"), belief.moebius(F.col("q"), F.col("scale_size")).alias("m")).first()
    assert r.q == pytest.approx(q) and r.m == pytest.approx(m.tolist())
    bodies = [{0: 0.1, 3: 0.5, 5: 0.4}, {6: 0.7, 7: 0.3}, {2: 1.0}]
    want = np.zeros(8)
    for (a, x), (b, y), (c, z) in ((p, q, r) for p in bodies[0].items() for q in bodies[1].items() for r in bodies[2].items()):
        want[a & b & c] += x * y * z
    df = spark.createDataFrame([("k", 3, b) for b in bodies] + [("k", 3, None), ("other", 3, {7: 1.0})], "k string, scale_size int, masses map<bigint,double>")
    got = belief.masses(belief.combined_bodies(df, ["k"]), ["k"]).where("k = 'k'").orderBy("subset").collect()
    assert [r.mass for r in got] == pytest.approx(want.tolist(), abs=1e-12)
    large = spark.createDataFrame([(12, {1: 0.5, 4095: 0.5})], "scale_size int, masses map<bigint,double>").withColumn("k", F.lit("l"))
    assert belief.masses(belief.combined_bodies(large, ["k"]), ["k"]).where("mass > 0.1").count() == 2


def test_legacy_bodies(spark):
    r = spark.createDataFrame([(1, 3, 0, 0.0, 1.0, 1.0), (2, 3, 0, 1.5, 1.0, 1.0), (3, 3, 7, 0.4, 1.0, 1.0), (4, 3, 1, 0.5, 0.0, None), (5, 3, 1, None, 0.5, 0.5)], "k int, scale_size int, mask long, agreement double, obs double, disc double")
    got = {x.k: x.masses for x in belief.legacy_bodies(r, ["k"]).collect()}
    assert got == {1: {0: 1.0, 7: 0.0}, 2: {0: 1.5, 7: -0.5}, 3: {7: 0.4, 0: 0.6}, 4: {1: 0.5, 7: 0.5}, 5: {1: 0.25, 7: 0.75}}
    assert {x.k: x.masses for x in belief.legacy_bodies(r, ["k"], closed=True).collect()} == {1: None, 2: None, 3: {7: 1.0}, 4: {1: 0.5, 7: 0.5}, 5: {1: 1.0, 7: 0.0}}


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_similar_vectors_loses_no_pair(spark, threshold):
    rng = random.Random(9)
    vectors = {i: {t: rng.choice([1.0, 2.0]) for t in rng.sample([f"t{k}" for k in range(12)], rng.randint(1, 5))} | {"common": 0.5} for i in range(60)}
    vectors |= {100 + i: dict(vectors[0]) for i in range(20)}
    df = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "id long, token string, weight double").repartition(3)
    first = {}
    for i in sorted(vectors):
        first.setdefault(tuple(sorted(vectors[i].items())), i)
    assert {r.id: r.class_id for r in text.vector_classes(df, "id").collect()} == {i: first[tuple(sorted(v.items()))] for i, v in vectors.items()}
    unit = {i: {t: w / math.sqrt(sum(x * x for x in vectors[i].values())) for t, w in vectors[i].items()} for i in first.values()}
    want = {(a, b): sum(x * unit[b].get(t, 0) for t, x in unit[a].items()) for a in unit for b in unit if a < b}
    got = {(r.left_id, r.right_id): r.cosine for r in text.similar_vectors(df, "id", threshold).collect()}
    assert got == pytest.approx({p: c for p, c in want.items() if round(c, 9) >= threshold}) and got


def test_matching_needs_equal_signatures(spark):
    from assayer.operators import contrasts

    rows = [("v3_a1_x", 1, "b1", "w", "2", 3), ("v3_b1_x", 1, "b2", "w", "2", 3), ("v3_a1_x", 2, "b", "w", "2", 3), ("v3_b1_x", 2, "b", "w", "2", 4), ("v3_a1_x", 3, "b", "w", "2", 3), ("v3_b1_x", 3, "b", "v", "2", 3), ("v3_a1_x", 4, "b", "w", "2", 3)]
    s = spark.createDataFrame(rows, "experiment_tag string, sample_ordinal int, bundle_signature string, window_signature string, bundle_size_signature string, response_rows int")
    c = contrasts.paired_families(s)
    got = {strict: {r.sample_ordinal: r.comparable for r in contrasts.matching(s, c, strict).collect()} for strict in (False, True)}
    assert got == {False: {1: True, 2: False, 3: False, 4: False}, True: {1: False, 2: True, 3: False, 4: False}}
    one = contrasts.matching_validation(contrasts.matching(s.where("sample_ordinal = 1"), c)).first()
    assert one.fully_matched and one.note == contrasts.NOTES[False][0]


def test_stuck_work_and_repairs(spark):
    rows = [(1, "k", "2024-01-01", "running", "", None), (2, "k2", "2024-01-01", "running", None, None), (3, "k2", "2024-01-02", "success", "ref", None), (4, "k4", "2024-09-01", "submitting", "", None), (5, "k5", "2024-01-01", "finalizing", "ref", "2024-02-01"), (6, "k6", "2024-01-01", "finalizing", "ref", "2024-09-01")]
    batches = spark.createDataFrame(rows, "batch_id long, key string, created string, status string, ref string, next_poll string")
    stuck = campaign.stuck_batches(batches, "2024-06-30")
    assert sorted((r.reason, r.batch_id) for r in stuck.collect()) == [("batch_missing_ref", 1), ("finalizing_no_progress", 5)]
    states = spark.createDataFrame([("sample:1:s", "exhausted")], "custom_key string, resolution string")
    dead = spark.createDataFrame([(7, "missing"), (7, "missing")], "request_id long, reason string")
    stalls = spark.createDataFrame([("p", "s")], "process string, stage string")
    requests = spark.createDataFrame([(8, "pending", None), (9, "pending", 1), (10, "error", None)], "request_id long, status string, batch_id long")
    work = campaign.stuck_work(states, dead, stalls, stuck, campaign.unowned(requests))
    assert work.count() == 7 and [tuple(r) for r in campaign.repair_plan(work).collect()] == [
        ("nudge_batch_poll_now", "5"), ("release_expired_batch_claim", "5"), ("repair_stage_transport", "7"), ("requeue_orphan_request", "8"), ("requeue_retryable_request", "p:s"),
    ]
