"""Tables of samples that are made without a row a stage and without a join of each method with another."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import contrasts, geometry, pools

SCHEMA = "experiment_tag string, sample_ordinal long, scale_size int, mask long, bundle_no long, agreement double, obs double, disc double"


@pytest.fixture
def responses(spark):
    rows = [(f"v3_{arm}_x", s, 3, (5 * s + 3 * i + len(arm) * (arm == "b1")) % 8, i, 0.1 * ((s + i) % 7), 0.9, 1.0) for s in range(30) for arm in ("a1", "b1") for i in range(3)]
    return spark.createDataFrame([*rows, ("v3_a1_x", 99, 3, 0, 0, 0.5, 1.0, 1.0)], SCHEMA).repartition(3)


def test_samples_are_read_once_for_both_worlds(responses):
    rows = geometry.with_belief(geometry.sample_metrics(responses), responses)
    assert rows.where("sample_ordinal = 99").select("tbm_conflict", "closed_world_conflict").first()[1] is None and rows.count() == 61
    plan = geometry.sample_instability(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1 and "Expand" not in plan


def test_methods_beside_each_other(responses):
    beside = pools.methods_beside(responses)
    methods = {(r.experiment_tag, r.sample_ordinal, r.method): r for r in pools.sample_methods(beside).collect()}
    pool = pools.pooled(responses).groupBy("experiment_tag", "sample_ordinal", "method").agg(F.sum(F.col("stage") * F.col("p")).alias("e"), F.sum("p").alias("s"), F.max("p").alias("top")).collect()
    assert len(pool) == len(methods) and ("v3_a1_x", 99, "linear") not in methods and methods["v3_a1_x", 99, "tbm"].top_p is not None
    for x in pool:
        m = methods[x.experiment_tag, x.sample_ordinal, x.method]
        assert m.top_p == (pytest.approx(x.top / x.s) if x.s > 0 else None) and m.expected_stage == (pytest.approx(x.e / x.s) if x.s > 0 else None)
    got = {r.method: r for r in pools.contrast_sensitivity(beside, contrasts.paired_families(responses)).collect()}
    for name in pools.METHODS:
        d = [methods["v3_b1_x", s, name].expected_stage - methods["v3_a1_x", s, name].expected_stage for s in range(30) if all((t, s, name) in methods and methods[t, s, name].expected_stage is not None for t in ("v3_a1_x", "v3_b1_x"))]
        d.sort()
        assert (got[name].n, got[name].mean_delta, got[name].median_delta) == (len(d), pytest.approx(sum(d) / len(d), abs=1e-12), pytest.approx((d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2, abs=1e-12))
    assert "Generate" not in beside._jdf.queryExecution().optimizedPlan().toString() and "Window" not in beside._jdf.queryExecution().optimizedPlan().toString()
