import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from assayer.llm.substring_dedup import remove_repeats


def brute(rows, k):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least = {}
    for i, w in split.items():
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            least[x] = min(i, least.get(x, i))
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ü!", "\x1cq"]
    passages = [list(rng.choice(vocab, rng.integers(8, 60))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "a " * 12), (5, "a " * 12), (6, "a " * 13), (7, "a " * 5000), (-8, " a\x0b" * 14)]
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(0, 40)))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(12)]
            cut = sorted(rng.integers(0, len(p) + 1, 2))
            w += p[cut[0] : cut[1]] + list(rng.choice(vocab, 3))
        rows.append((10 + i, " ".join(w)))
    rows.append((999, rows[40][1]))
    return rows


def test_every_repeated_window_is_removed(spark, monkeypatch):
    monkeypatch.setattr("assayer.llm.substring_dedup.BLOCK_BYTES", 9000)
    rows = corpus(5, 300)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, found int").repartition(5)
    got = remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute(rows, 13)
    assert all(f.length >= 13 and f.source < r.doc_id for r in got for f in r.factors)


def test_no_rows_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(None, t), (3, t), (3, t), (3, "other " + t), (4, t)], schema)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(0, 20, 0), (3, 20, 0), (3, 20, 0), (3, 21, 0), (4, 20, 20)]
