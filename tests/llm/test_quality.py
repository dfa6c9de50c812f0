import random
from zlib import crc32

import numpy as np
import pyarrow as pa

from assayer.llm import quality
from assayer.llm.queries import op11_quality

WORDS = [a + b for a in ("ba", "ko", "lé", "mi", "tu") for b in ("ra", "no", "s", "rem")]


def text(rng, good, n):
    words = rng.choices(WORDS, k=n)
    if good:
        return " ".join(words)
    return " ".join(w.upper() + "!!" for w in words) if rng.random() < 0.5 else " ".join(w for w in words[: n // 8 + 1] for _ in range(8))


def test_features_are_counted_by_hand():
    doc, bucket, n = quality.features(pa.array(["ab ab", None, "", " \n", "ab", "xy"]))
    # Words 2, pair 1; grams of " ab ab ": 2 bytes ( a, ab, "b ") twice each, 3 bytes ( ab, "ab ") twice, 4 bytes (" ab ") twice.
    assert n.tolist() == [2 + 1 + 6 + 4 + 2, 0, 0, 0, 1 + 3 + 2 + 1, 7]
    bags = [sorted(bucket[doc == d].tolist()) for d in range(6)]
    assert set(bags[4]) < set(bags[0]) and len(set(bags[0])) == len(set(bags[4])) + 1
    assert not set(bags[4]) & set(bags[5])
    long = quality.features(pa.array(["x " * 70000 + "ab"]))
    assert set(bags[4]) < set(long[1].tolist())


def test_held_out_documents_are_told_apart(spark, tmp_path):
    rng = random.Random(2)
    kinds = {i: rng.random() < 0.8 for i in range(900)}
    docs = [(i, text(rng, kinds[i], rng.randint(8, 60)), "x") for i in kinds] + [(1000, None, "x"), (1001, "", "x"), (None, text(rng, True, 9), "x"), (5, "again", "x")]
    labels = [(i, int(k), 0) for i, k in kinds.items() if i % 2 == 0] + [(7, None, 0), (None, 1, 0), (9, 0, 0), (9, 1, 0), (5000, 0, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op11_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    unseen = [r for r in got if r.doc_id in kinds and r.doc_id != 5 and (r.held_out or r.doc_id % 2)]
    assert len(unseen) > 400 and np.mean([r.predicted == kinds[r.doc_id] for r in unseen]) > 0.98
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    again = {r.doc_id: r.score for r in op11_quality(spark, str(tmp_path)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got if r.doc_id != 5)


def test_no_labels_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    for known, want in ((labels.limit(0), 0.5), (labels, 0.98)):
        scores = [r.score for r in quality.score_quality(docs, quality.fit_quality(docs, known), ["doc_id"]).collect()]
        assert len(scores) == 2 and all(abs(s - want) < 0.01 for s in scores)
    model = quality.fit_quality(docs.limit(0), labels)
    assert quality.score_quality(docs.limit(0), model, ["doc_id"]).count() == 0
