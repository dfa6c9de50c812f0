import numpy as np
import pytest

from assayer.operators.resampling import FLIPS_FROM, draws, poisson_limits, resampled


def test_draws_are_even_and_independent():
    x = draws(np.arange(400), np.arange(500))
    assert x.min() >= 0 and abs(x.mean() / 2147483647 - 0.5) < 0.002 and len(np.unique(x)) > 199_900
    bits = (x % 2 * 2 - 1).astype(float)
    assert abs(np.corrcoef(bits[:40])[np.triu_indices(40, 1)]).max() < 0.25 and abs(np.corrcoef(bits[:, :40].T)[np.triu_indices(40, 1)]).max() < 0.25
    times = np.searchsorted(poisson_limits(), x, side="right")
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02


def test_equals_drawing_whole_groups(spark):
    rng = np.random.default_rng(4)
    groups = {("c1", "x"): rng.normal(0.1, 1, 300), ("c1", "y"): np.round(rng.normal(0.9, 1, 40), 1), ("c2", "x"): np.array([2.5]), ("c2", "y"): np.array([0.5, -0.5]), ("c3", "x"): np.full(9, 1.0)}
    rows = [(*g, i * 7, float(v)) for g, d in groups.items() for i, v in enumerate(d)] + [("c1", "x", 10**7, None)]
    df = spark.createDataFrame(rows, "contrast_id string, endpoint string, sample_ordinal long, delta double")
    got = {(r.contrast_id, r.endpoint): r for r in resampled(df.repartition(5), 500, 800).collect()}
    assert sorted(resampled(df.repartition(1), 500, 800).collect())[0].p_value == got["c1", "x"].p_value
    for g, d in groups.items():
        samples = np.arange(len(d)) * 7
        times = np.searchsorted(poisson_limits(), draws(samples, np.arange(500)), side="right")
        with np.errstate(invalid="ignore"):
            means = (times * d[:, None]).sum(axis=0) / times.sum(axis=0)
        low, high = (d[0], d[0]) if len(d) == 1 else np.quantile(means[np.isfinite(means)], [0.025, 0.975])
        flipped = ((draws(samples, np.arange(800) + FLIPS_FROM) % 2 * 2 - 1) * d[:, None]).mean(axis=0)
        p = 1.0 if abs(d.mean()) < 1e-12 else ((abs(flipped) >= abs(d.mean()) - 1e-12).sum() + 1) / 801
        assert (got[g].ci_low, got[g].ci_high, got[g].p_value) == (pytest.approx(low), pytest.approx(high), pytest.approx(p)), g
    big = groups["c1", "x"]
    assert got["c1", "x"].ci_low == pytest.approx(big.mean() - 1.96 * big.std() / 300**0.5, abs=0.05)
    assert got["c1", "y"].p_value < 0.01 < got["c1", "x"].p_value + 0.5 and resampled(df.limit(0)).count() == 0
