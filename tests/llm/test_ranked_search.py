import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import ranked_search as rs
from assayer.llm.words import LETTERED, word_counts, words


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    words_of = [(d, Counter(terms(t))) for d, t in docs]
    words_of = [(d, c, sum(c.values())) for d, c in words_of if c]
    n, total = len(words_of), sum(x for _, _, x in words_of)
    df = Counter(t for _, c, _ in words_of for t in c)
    out = []
    for i, text in items:
        asked = Counter(t for t in terms(text) if t in df)
        scores = []
        for d, c, x in words_of:
            m = 25 + 75 * x * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes,block_terms", [(1, 1 << 18), (3000, 9), (1 << 20, 40)])
def test_equals_scoring_every_document(spark, shard_bytes, block_terms):
    rng = random.Random(shard_bytes)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "THE", "x_y", "0"]
    draw = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(rng.randint(-50, 10**6), draw(rng.choice([1, 3, 30, 200]))) for _ in range(150)]
    docs += [(1000 + i, docs[0][1]) for i in range(70)] + [(7, "the same"), (7, "the same"), (None, draw(40)), (None, draw(40)), (3, None), (4, ""), (5, "?!"), (6, "only once")]
    rng.shuffle(docs)
    items = [(i, draw(rng.choice([1, 5, 40]))) for i in range(20)] + [(20, None), (21, "unseen words"), (22, docs[0][1] or ""), (22, "THE the The"), (None, "only once"), (23, draw(3) + " unseen")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    size = rs.corpus_size(d)
    got = found(rs.search(rs.written(rs.build_index(d, size, shard_bytes), "index"), b, size, block_terms=block_terms))
    assert got == brute(docs, items)


def test_nothing_to_search(spark):
    docs, items = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert rs.ranked_search(docs, items).count() == 0
    assert rs.ranked_search(docs.limit(0), items).count() == 0
    assert rs.ranked_search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_a_search_leaves_most_of_a_tree_alone():
    rng = np.random.default_rng(1)
    length = np.full(4096, 20)
    hashes = rng.integers(1, 400, length.sum()).astype(np.uint64)
    tree_of = rs.build_shard(np.arange(4096), hashes, np.arange(4097) * 20, 4096, int(length.sum()))
    row = {c: tree_of[c].astype(t).tobytes() for c, t in (("docs", np.int64), ("hashes", np.uint64), ("starts", np.int32), ("impacts", np.int32))} | {"unnamed": 0, "zeros": tree_of["zeros"], "bits": tree_of["bits"]}
    tree, looked = rs.Tree(row), 0
    ones = tree.ones
    for level in range(12):
        assert tree.zeros[level] == len(hashes_of := tree.impacts[level]) - ones[level][-1] and len(hashes_of) == len(tree.impacts[0])

    class Counted(list):
        def __getitem__(self, at):
            nonlocal looked
            looked += 1
            return super().__getitem__(at)

    tree.ones = Counted(ones)
    best = rs.Best(1, 10)
    rs.search_shard(tree, np.zeros(3, int), np.array([5, 9, 300], np.uint64), np.array([3000, 2000, 50]), best, width=1)
    assert len(best.score) == 10 and looked < 4096


def test_word_counts():
    texts = pa.array(["", "a b", None, "  é-1 ", "x", "A" * 9 + "\n?z"])
    assert word_counts(texts, LETTERED, lower=True).tolist() == np.diff(words(texts, LETTERED, lower=True).first).tolist() == [0, 2, 0, 2, 1, 2]
