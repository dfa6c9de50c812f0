import itertools
import re

import numpy as np

from pyspark.sql import functions as F

import assayer.llm.line_dedup as line_dedup
from assayer.llm.line_dedup import remove_repeated_lines


def words(line):
    return frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)


def brute(rows):
    """rows in order of id; each id once."""
    seen, out = [], {}
    for i, text in rows:
        kept, n, gone = [], 0, 0
        for line in [] if text is None else text.split("\n"):
            w = words(line)
            n += bool(w)
            if w and any(5 * len(w & x) >= 4 * len(w | x) for x in seen):
                gone += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = (None if text is None else "\n".join(kept), n, gone)
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocab = [f"w{int(x)}" for x in range(120)] + ["É", "ß"]
    base = [list(rng.choice(vocab, rng.integers(1, 25))) for _ in range(25)]
    rows = [(-1, None), (1, ""), (2, " \t\n\n"), (3, "a\nA\r\n b"), (4, "the the of\nof the"), (5, "x " * 4000)]
    for i in range(n):
        lines = []
        for _ in range(rng.integers(1, 7)):
            w = list(base[rng.integers(25)])
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = str(rng.choice(vocab))
            lines.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
        rows.append((10 + i, "\n".join(lines)))
    return rows


def test_every_later_match_goes(spark):
    rows = corpus(2, 150)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, line int, class string").repartition(4)
    got = remove_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "line", "class", "n_lines", "n_removed", "n_links"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute(rows)


def test_no_rows_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert remove_repeated_lines(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "p q r"), (2, "p q r\nu v"), (2, "p q r\nu v"), (3, "u v\n\nz")], schema)
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in remove_repeated_lines(docs).collect())
    assert got == [(0, "p q r", 0), (2, "u v", 1), (2, "u v", 1), (3, "\nz", 1)]


def test_lines_go_alike_without_counting_links(spark):
    rng = np.random.default_rng(4)
    # One group of near-equal lines in two thirds of the rows: each has one to nine of 60 words replaced.
    base = [f"b{i}" for i in range(60)]
    rows = corpus(3, 60)
    for i in range(160):
        w = list(base)
        for k in rng.choice(60, rng.integers(1, 10), replace=False):
            w[k] = f"v{int(rng.integers(400))}"
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeated_lines(docs, count=False)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute(rows)
    odd = spark.createDataFrame([(None, "p q r"), (2, "p q r\nu v"), (2, "p q r\nu v"), (3, "u v\n\nz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in remove_repeated_lines(odd, count=False).collect())
    assert got == [(0, "p q r", 0), (2, "u v", 1), (2, "u v", 1), (3, "\nz", 1)]
    assert remove_repeated_lines(odd.limit(0), count=False).count() == 0


def test_sketches_tell_sets_apart_and_lose_no_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (40, 90):
        for gone in range(0, n // 3):
            a = rng.integers(0, 1 << 57, n)
            rows.append((gone, n, a.tolist(), [*a[gone:].tolist(), *rng.integers(0, 1 << 57, gone).tolist()]))
    sets = spark.createDataFrame(rows, "gone int, n_a int, a array<long>, b array<long>").withColumn("n_b", F.col("n_a"))
    sets = sets.select("gone", "n_a", "n_b", *(line_dedup._map(F.col(s), i).alias(f"map{i}_{s}") for s in "ab" for i in (0, 1)))
    got = sets.select("gone", F.col("n_a").alias("n"), line_dedup._alike(80).alias("alike")).collect()
    assert all(r.alike for r in got if 5 * (r.n - r.gone) >= 4 * (r.n + r.gone))
    far = [r.alike for r in got if 7 * r.gone >= r.n]  # a similarity of 3/4 or less
    assert sum(far) <= len(far) / 4


def test_most_of_a_group_is_found_before_all_its_pairs_are(spark, monkeypatch):
    rng, made = np.random.default_rng(6), {}
    # Earlier lines that hold a third of the group's words and share one of its samples now and then.
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.choice(base, 20, replace=False), *(f"u{i}x{k}" for k in range(40))])) for i in range(200)]
    for i in range(160):
        w = list(base)
        for k in rng.choice(60, rng.integers(1, 7), replace=False):
            w[k] = f"v{int(rng.integers(400))}"
        rows.append((1000 + i, " ".join(w)))
    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: made.setdefault(name, []).append(written(df, name)) or made[name][-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in remove_repeated_lines(docs, count=False).collect()}
    assert got == {i: gone for i, (_, _, gone) in brute(rows).items()}
    assert made["pairs"][0].count() <= 10 * 160


def degrees(rows, percent):
    """Of rows in order of id the number of links of the classes that each has the first line of, and the number of all links."""
    first = {}
    for i, text in rows:
        for line in [] if text is None else text.split("\n"):
            if w := words(line):
                first.setdefault(w, i)
    out, links = {i: 0 for i, _ in rows}, 0
    for a, b in itertools.combinations(first, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            links += 1
            for w in (a, b):
                out[first[w]] += 1
    return out, links


def test_links_of_a_large_group_are_counted_but_not_made(spark, monkeypatch):
    rng, made = np.random.default_rng(7), {}
    # A group of lines that have up to four of 60 words replaced, some by the same ones.
    base = [f"b{i}" for i in range(60)]
    rows = [*corpus(8, 20), (999, " ".join(base))]
    for i in range(160):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            w[k] = f"v{int(rng.integers(40))}"
        rows.append((1000 + i, " ".join(w)))
    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: made.setdefault(name, []).append(written(df, name)) or made[name][-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in remove_repeated_lines(docs).collect()}
    want, links = degrees(rows, 80)
    assert got == want
    assert made["links"][0].count() <= links / 4


def test_pairs_by_far_and_apart_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pivot = [f"p{i}" for i in range(40)]
    rows = [(0, " ".join(pivot))]
    for i in range(1, 120):
        gone = rng.choice(40, rng.integers(0, 5), replace=False)
        rows.append((i, " ".join([*(w for k, w in enumerate(pivot) if k not in gone), *(f"v{int(x)}" for x in rng.integers(0, 6, rng.integers(0, 6)))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for few in (0, 3, 32):
        monkeypatch.setattr(line_dedup, "FEW", few)
        got = {r.doc_id: r.n_links for r in remove_repeated_lines(docs).collect()}
        assert got == degrees(rows, 80)[0]


def test_near_equal_lines_meet_at_their_first_shared_key(spark, monkeypatch):
    rng, made, sharing = np.random.default_rng(10), [], line_dedup._sharing
    # Two in three lines of a group are linked, and share many prefix words.
    base = [f"b{i}" for i in range(60)]
    rows = corpus(11, 20)
    for i in range(120):
        w = list(base)
        for k in rng.choice(60, rng.integers(1, 8), replace=False):
            w[k] = f"v{int(rng.integers(60))}"
        rows.append((1000 + i, " ".join(w)))
    want, _ = degrees(rows, 80)

    def watched(*args, **more):
        made.append((sharing(*args, **more), sharing(*args, **more | {"close": None})))
        return made[-1][0]

    monkeypatch.setattr(line_dedup, "_sharing", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # All words rare, as here; some common; all common, whose keys are pairs of words.
    for common in (11, 6, 1):
        monkeypatch.setattr(line_dedup, "COMMON", common)
        assert {r.doc_id: r.n_links for r in remove_repeated_lines(docs).collect()} == want
        once, all_keys = made.pop()
        pairs = all_keys.distinct()
        assert once.distinct().exceptAll(pairs).count() == pairs.exceptAll(once.distinct()).count() == 0
        assert once.count() <= 1.25 * pairs.count() < 2.5 * pairs.count() <= all_keys.count()
