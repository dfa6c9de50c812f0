import hashlib
import random
from collections import defaultdict
from zlib import crc32

from assayer.llm.prefix_trie import prefix_trie
from assayer.llm.queries import ORACLE_SQL, op13_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """The nodes of a dict of lists of (role, text), by walking the trie itself."""
    members = defaultdict(list)
    for c in sorted(conversations):
        for d in range(len(conversations[c]) + 1):
            members[tuple(conversations[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    out = []
    for p, cs in members.items():
        sub = list(below(p))
        ends = ",".join(str(c) for c in cs if len(conversations[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), len(children[p]), sum(not children[q] for q in sub), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_walking_the_trie(spark):
    rng = random.Random(7)
    talks = {c: [(rng.choice("ua"), rng.choice(["x", "é", "", "long " * 9])) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13]))] for c in range(40)}
    talks |= {c: [("u", "hot"), ("a", "copy"), ("u", "copy")] for c in range(100, 160)}
    talks |= {500: [("u", "hot")] * 37, 501: [("u", "hot")] * 36 + [("a", "hot")], 502: [("u", "hot")] * 32, -3: [("u", "hot")] * 31}
    turns = [(c, i if i else None, *t, "more") for c, ts in talks.items() for i, t in enumerate(ts)] + [(None, 1, "u", "x", "more")]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, depth string").repartition(5)
    assert rows_of(prefix_trie(df)) == brute({c: t for c, t in talks.items() if t})


def test_nulls_are_empty_and_role_and_text_are_told_apart(spark):
    turns = [(1, 0, None, None), (2, 0, "", ""), (3, 0, "u", "v"), (4, 0, "uv", ""), (5, 0, "", "uv"), (6, 3, "b", "y"), (6, 3, "b", "y"), (6, None, "a", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    want = brute({1: [("", "")], 2: [("", "")], 3: [("u", "v")], 4: [("uv", "")], 5: [("", "uv")], 6: [("a", "x"), ("b", "y"), ("b", "y")]})
    assert rows_of(prefix_trie(df)) == want
    assert prefix_trie(df.limit(0)).count() == 0


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def test_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(11)
    talks = {c: [("u", rng.choice(["x", "y", "é"])) for _ in range(rng.randint(1, 12))] for c in range(60) if c % 15}
    turns = [(c, i, *t) for c, ts in talks.items() for i, t in enumerate(ts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_prefix_trie(spark, str(tmp_path))
    want = brute(rebuilt(talks))
    assert rows_of(got) == want
    assert any(not t for t in rebuilt(talks).values()) and "op13_prefix_trie" in ORACLE_SQL
