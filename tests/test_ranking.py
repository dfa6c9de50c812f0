import random

import numpy as np

from assayer.operators.ranking import order_statistics, ranked, value_counts


def test_rows_are_numbered_and_added_across_slices(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, w int").repartition(5)
    got = ranked(df, ["k"], ["i"], sums=["w"], slices=13).collect()
    assert len(got) == 900
    for key in ("hot", "a", "b", None):
        mine = sorted((i, w) for k, i, w in rows if k == key)
        want = [(i, n, len(mine), int(s), sum(w for _, w in mine)) for n, ((i, _), s) in enumerate(zip(mine, np.cumsum([w for _, w in mine]), strict=True), 1)]
        assert sorted((r.i, r.row_no, r.n_rows, r.w_to, r.w_all) for r in got if r.k == key) == want


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "v int, i int")
    assert sorted((r.v, r.i, r.row_no) for r in ranked(df, [], ["v", "i"], slices=4).collect()) == [(v, i, n) for n, (v, i) in enumerate(sorted((i % 7, i) for i in range(50)), 1)]
    assert ranked(df.limit(0), ["v"], ["i"], sums=["i"]).count() == 0


def test_quantiles_and_trimmed_means_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xxxxy"), rng.choice([None, 1.0, 1.0, 2.5, rng.random()]), float(rng.randint(0, 3))) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: r for r in order_statistics(value_counts(df, ["k"], ["a", "b"]), ["k"], ["a", "b"], {"median": 0.5, "q1": 0.25, "top": 1.0}, trim=0.1).collect()}
    for key in "xy":
        for at, name in ((1, "a"), (2, "b")):
            v = np.sort([r[at] for r in rows if r[0] == key and r[at] is not None])
            cut = int(len(v) * 0.1)
            for q, p in (("median", 0.5), ("q1", 0.25), ("top", 1.0)):
                assert abs(got[key][f"{name}_{q}"] - np.quantile(v, p)) < 1e-12
            assert abs(got[key][f"{name}_trimmed_mean"] - v[cut : len(v) - cut].mean()) < 1e-12
