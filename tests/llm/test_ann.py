import numpy as np
from pyspark.sql import functions as F

from assayer.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, list string"


def brute(x, ids, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit[ids.tolist().index(q)]
    order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr("assayer.llm.ann.BLOCK", 300)
    monkeypatch.setattr("assayer.llm.ann.CHUNK", 7)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 24)), np.tile(rng.normal(size=(1, 24)), (700, 1)) + rng.normal(size=(700, 24)) * 0.01]).astype(np.float32)
    ids = np.arange(len(x)) * 5
    vectors = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(3)
    got = nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    hits, x = 0, x.astype(float)
    for q in ids[ids % 50 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        want = brute(x, ids, q, 5)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(a.score >= b.score for a, b in zip(mine, mine[1:]))
        hits += len({r.vec_id for r in mine} & {i for i, _ in want})
    assert hits / (5 * sum(ids % 50 == 0)) >= 0.9


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert nearest(vectors, vectors.limit(0)).count() == 0


def test_many_near_copies_that_the_sample_does_not_hold(spark, monkeypatch):
    monkeypatch.setattr("assayer.llm.ann.SAMPLE", 500)
    rng = np.random.default_rng(3)
    sampled = [r.id for r in spark.range(3500).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(500).collect()]
    x = (rng.normal(size=(1, 64)) + rng.normal(size=(3500, 64)) * 0.01).astype(np.float32)
    x[sampled] = rng.normal(size=(500, 64))
    asked = [i for i in range(0, 3500, 50) if i not in set(sampled)]
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = nearest(vectors, vectors.where(F.col("vec_id").isin(asked)), probes=256).collect()
    hits, x, ids = 0, x.astype(float), np.arange(len(x))
    for q in asked:
        hits += len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in brute(x, ids, q, 5)})
    assert hits == 5 * len(asked)  # all lists are looked into, so nothing is lost
