import itertools
import re

import numpy as np

from assayer.llm.near_dedup import joint_estimate, near_duplicates, registers


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            at[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, 60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É é"), (8, "é é"), (9, " x " * 3000), (10, "x x")]
    for i in range(n):
        w = list(base[rng.integers(6)])
        for _ in range(rng.integers(0, 9)):
            w[rng.integers(60)] = rng.choice(vocab)
        rows.append((100 + i, " ".join(w)))
    return rows


def test_components_equal_those_of_all_pairs(spark):
    rows = corpus(3, 250)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=2).collect()}
    want = brute(rows, 2, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_no_rows_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")], schema)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 2, False)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    assert (registers(np.concatenate([a, b])) == np.maximum(registers(a), registers(b))).all()
    j = joint_estimate(registers(a)[None], registers(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 0.6) < 0.1


def test_a_hot_group_with_chains_beside_its_centre(spark):
    """Near copies in chains: most are linked with the centre, some only with each other, some with a copy at the rim."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 14), replace=False):
            w[j] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    for chain in range(6):
        w = list(base)
        for step in range(12):
            for j in range(chain + step * 8, chain + step * 8 + 4):
                w[j] = f"c{chain}_{j}"
            rows.append((1000 + chain * 20 + step, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}


def test_words_that_a_polynomial_hash_confuses():
    from assayer.llm.words import words
    import pyarrow as pa

    thue = [bin(i).count("1") % 2 for i in range(4096)]
    texts = ["".join("ab"[b ^ flip] for b in thue) for flip in (0, 1)]
    one, two = words(pa.array(texts)).hash
    assert one != two
    assert (words(pa.array([texts[0] + " x", "y " + texts[0]])).hash[[0, 3]] == one).all()
