import hashlib
import re

import numpy as np

from assayer.llm.decontamination import contamination, decontaminate


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    out = {}
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for j, b in items:
            x = split(b)
            n = min(k, len(x))
            grams = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    ids.add(str(j))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(200)] + ["é", "Ü", "no:", "x-y"]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(1, 40)))) for i in range(30)] + [(100, None), (101, ""), (102, "..."), (103, "w1")]
    rows = [(1, None), (2, ""), (3, "?!"), (4, "W1"), (5, "z " * 9000)]
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(0, 60)))
        if rng.random() < 0.5:
            x = (items[rng.integers(30)][1]).split()
            a, b = sorted(rng.integers(0, len(x) + 1, 2))
            w += x[a:b] + list(rng.choice(vocab, 5)) + x[max(0, a - 3) : b]
        rows.append((10 + i, " ".join(w)))
    return rows, items


def test_hits_equal_those_of_all_windows(spark, monkeypatch):
    rows, items = corpus(4, 200)
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, row int, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, 10)
    for size in (1 << 20, 500):  # one block and several
        monkeypatch.setattr("assayer.llm.decontamination.BLOCK_BYTES", size)
        got = contamination(docs, bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
        clean = decontaminate(docs, bench)
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[4]}


def test_longest_match_and_its_place(spark):
    item = " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "lead in " + " ".join(f"B{i}," for i in range(5, 25)) + " out")], "doc_id long, text string")
    spans = contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first().spans
    assert [(s.item, s.start, s.length) for s in spans] == [("7", 2, 20)]


def test_empty_tables_and_null_ids(spark):
    docs, bench = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], docs)
    assert contamination(spark.createDataFrame([], docs), spark.createDataFrame([], bench)).count() == 0
    assert [r.n_hit for r in contamination(some, spark.createDataFrame([], bench)).collect()] == [0, 0, 0]
    assert [(r.n_hit, r.n_items) for r in contamination(some, spark.createDataFrame([(None, "a b")], bench)).collect()] == [(2, 0)] * 3
    assert decontaminate(some, spark.createDataFrame([(5, "B")], bench)).count() == 0
