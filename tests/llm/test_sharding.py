from collections import Counter
from zlib import crc32

from assayer.llm.sharding import communication_matrix, shuffle_into_shards, write_shards


def test_matrix_has_exact_sums_and_is_unbiased():
    blocks, shards = [1000, 3, 0, 517, 80], [400, 400, 400, 400]
    assert [sum(r) for r in communication_matrix(blocks, shards, 1)] == blocks
    cell = [communication_matrix(blocks, shards, s) for s in range(400)]
    assert all([sum(c) for c in zip(*m, strict=True)] == shards for m in cell)
    for s in range(4):
        assert abs(sum(m[3][s] for m in cell) / 400 - 517 / 4) < 3


def test_shards_are_exact_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr("assayer.llm.sharding.BUCKET_ROWS", 13)
    rows = [(i, f"text {i} é", "x") for i in range(500)] + [(None, None, "x"), (7, "", "x"), (7, "", "x"), (8, "same", "y"), (9, "same", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = shuffle_into_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, _ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    first = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None][:40]
    assert first != sorted(first)


def test_no_rows(spark):
    assert shuffle_into_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_written(spark, tmp_path):
    docs = spark.createDataFrame([(i % 90, f"t{i % 80}", i) for i in range(100)], "doc_id long, text string, extra int")
    write_shards(docs, f"{tmp_path}/s", shards=3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert Counter(r.extra for r in back.collect()) == Counter(range(100))
    assert Counter(r._shard for r in back.collect()) == {0: 34, 1: 33, 2: 33}
