"""Beliefs worked out of responses by key, against bodies of evidence combined one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions.verdicts import expected_stage, rounded
from assayer.operators import belief


def rows_of(spark, n=900, seed=3):
    """Responses of many keys, one of which has most of them, with null and unknown values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(["hot"] * 6 + [None, *(f"k{j}" for j in range(60))])
        scale = 3 if k in ("hot", "k1", None) else 5
        mask = rng.choice([0, (1 << scale) - 1, *(rng.randrange(1 << scale) for _ in range(6))])
        if k == "hot":
            mask = rng.choice([3, 2, 7])
        rows.append((k, i % 2 if k == "k1" else 1, scale, mask, 0.002 * rng.randint(0, 3) if k == "hot" else rng.choice([0.0, 0.2, 0.5, None]), rng.choice([0.0, 0.9, None]), rng.choice([0.7, 1.0])))
    return spark.createDataFrame(rows, "k string, s int, scale_size int, mask long, agreement double, obs double, disc double").repartition(5)


def by_key(df):
    return {(r.k, r.s): r for r in df.collect()}


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("held", [1 << 20, 64])
def test_legacy_beliefs_equal_combined_bodies(spark, monkeypatch, closed, held):
    monkeypatch.setattr(belief, "HELD", held)
    r, keys = rows_of(spark), ["k", "s"]
    got = belief.beliefs(r, keys, closed, legacy=True)
    want = {(x.k, x.s, x.stage): x for x in belief.pignistic(belief.combined_bodies(belief.legacy_bodies(r, keys, closed), keys), keys).collect()}
    found = {(x.k, x.s, x.stage): x for x in belief.by_stage(got, keys).collect()}
    assert found.keys() == want.keys() and len(found) > 200
    for k, x in found.items():
        assert (x.bet_p, x.conflict) == (pytest.approx(want[k].bet_p, abs=1e-9), pytest.approx(want[k].conflict, abs=1e-9))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan  # no row a set is dealt out


def test_beliefs_and_worlds_equal_commonalities(spark):
    r, keys = rows_of(spark, seed=4), ["k", "s"]
    both = by_key(belief.worlds(r, keys))
    for closed, name in ((False, "tbm"), (True, "closed_world")):
        one, q = by_key(belief.beliefs(r, keys, closed)), belief.commonalities(r, keys, closed)
        slow = belief.pignistic(q, keys).groupBy(*keys).agg(F.max("conflict").alias("conflict"), F.sum(F.col("stage") * F.col("bet_p")).alias("e"), F.array_sort(F.collect_list(F.struct("stage", "bet_p"))).alias("bet")).collect()
        assert len(slow) == len(one)
        for x in slow:
            assert one[x.k, x.s].bet == pytest.approx([b.bet_p for b in x.bet], abs=1e-12) and one[x.k, x.s].conflict == pytest.approx(x.conflict, abs=1e-12)
            assert both[x.k, x.s][f"{name}_conflict"] == pytest.approx(x.conflict, abs=1e-12) and both[x.k, x.s][f"{name}_expected_stage"] == pytest.approx(x.e, abs=1e-12)
        assert sum(x[f"{name}_conflict"] is not None for x in both.values()) == len(one)


def test_a_hot_key_leaves_a_task_as_its_verdicts(spark):
    r = spark.range(40000).select(F.lit("k").alias("k"), F.lit(3).alias("scale_size"), (F.col("id") % 8).alias("mask"), F.lit(0.0001).alias("agreement"), F.lit(1.0).alias("obs"), F.lit(1.0).alias("disc"))
    got = belief.beliefs(r.repartition(2), ["k"]).collect()
    assert len(got) == 1 and got[0].conflict == pytest.approx(1.0) and got[0].bet == [0.0, 0.0, 0.0]


def test_expected_stage_and_rounding(spark):
    rng = random.Random(1)
    masks = [(rng.randrange(1 << n), n) for n in (1, 4, 7, 9, 40, 62) for _ in range(20)] + [(0, 5), (1 << 62, 63)]
    for r, (m, n) in zip(spark.createDataFrame(masks, "m long, n int").coalesce(1).select(expected_stage(F.col("m"), F.col("n"))).collect(), masks, strict=True):
        stages = [s for s in range(1, n + 1) if m >> (s - 1) & 1]
        assert r[0] == (sum(stages) / len(stages) if stages else None)
    values = [0.5e-9, -1.5e-9, 2.5e-9, 0.1234567885, -0.0, 1e20, -1e16 - 2, 0.1 + 0.2, None, float("nan"), float("inf"), 12345.6789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(rounded(F.col("v"))).collect()]
    assert got[:4] == [1e-9, -2e-9, 3e-9, 0.123456789] and str(got[4]) == "0.0" and got[5:8] == [1e20, -1e16 - 2, 0.3] and got[8] is None and np.isnan(got[9]) and got[10] == float("inf") and got[11] == 12345.6789


def test_weighted_belief_equals_rows_one_by_one(spark):
    from assayer.operators import reports

    rng = random.Random(7)
    rows = [("e", rng.randrange(40), rng.randrange(2), 4 if i % 9 == 0 else 3, rng.randrange(8), rng.choice([0.3, 0.6]), 0.0 if i % 5 == 0 else rng.choice([0.5, 0.9, None]), 1.0) for i in range(500)]
    rows += [("f", s, 0, 3, rng.choice([1, 2, 4]), 0.5, 0.0, 1.0) for s in range(9)]  # weights 0
    r = spark.createDataFrame(rows, "experiment_tag string, sample_ordinal long, bundle_no int, scale_size int, mask long, agreement double, obs double, disc double").repartition(3)
    whole = {}
    for x in belief.by_stage(belief.beliefs(r, ["experiment_tag", "sample_ordinal"]), ["experiment_tag", "sample_ordinal"]).collect():
        whole[x[0], x[1]] = max(whole.get((x[0], x[1]), 0.0), x.conflict)
    weight = {x[0:2]: x.w or 0.0 for x in r.groupBy("experiment_tag", "sample_ordinal").agg(F.avg(F.col("obs") * F.col("disc")).alias("w")).collect()}
    points = {}
    for x in belief.by_stage(belief.beliefs(r, ["experiment_tag", "sample_ordinal", "bundle_no"]), ["experiment_tag", "sample_ordinal", "bundle_no"]).collect():
        if whole[x[0], x[1]] < 0.9:
            points.setdefault((x[0], x[2], x.stage), []).append((round(x.bet_p, 9), weight[x[0], x[1]], x[1]))
    got = reports.weighted_belief(r, reports.rubric_weights(r)).collect()
    assert {(x.experiment_tag, x.bundle_no, x.stage) for x in got} == points.keys()
    for x in got:
        v, w, s = (np.array(c) for c in zip(*sorted(points[x.experiment_tag, x.bundle_no, x.stage]), strict=True))
        w = w if w.sum() > 0 else np.ones(len(w))
        assert (x["mean"], x.rubrics, x.weight_sum) == (pytest.approx((v * w).sum() / w.sum(), abs=1e-8), len(set(s)), pytest.approx(w.sum()))
        assert (x.q10, x.q90) == (pytest.approx(np.interp(0.1, np.cumsum(w) / w.sum(), v), abs=1e-7), pytest.approx(np.interp(0.9, np.cumsum(w) / w.sum(), v), abs=1e-7))
