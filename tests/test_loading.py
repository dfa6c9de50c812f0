import os

import pytest
from pyspark.sql import functions as F

from assayer.sources import documents
from assayer.sources.embeddings import EmbeddingCache
from assayer.sources.snapshots import ContractError, SnapshotStore


def test_documents_come_back_as_they_were(spark):
    rows = [(1, True, [1, None, 3], {"a": 1}, ("x", ["é", 'q"'])), (2, None, None, None, None), (3, False, [], {}, (None, []))]
    df = spark.createDataFrame(rows, "i int, flag boolean, list array<int>, map map<string,int>, one struct<label: string, criteria: array<string>>")
    flat = documents.encoded(df)
    assert flat.columns == ["i", "flag", "list_json", "map_json", "one_json"] and dict(flat.dtypes)["flag"] == "int"
    back = {r.i: r for r in documents.decoded(flat, {"list": "array<int>", "map": "map<string, int>", "one": "struct<label: string, criteria: array<string>>"}).collect()}
    for i, _, a, m, one in rows:
        assert back[i].list == a and back[i].map == m and (back[i].one and (back[i].one.label, back[i].one.criteria)) == one
    assert back[1].decode_errors == [] and back[2].decode_errors == ["list: missing", "map: missing", "one: missing"]


def test_bad_documents_are_named(spark):
    texts = ["[1, 2]", "[1, null]", "[1, ", '{"a": 1}', '[1, "x"]', "null", "3", ""]
    df = spark.createDataFrame([(t,) for t in texts], "list_json string")
    got = [(r.list, r.decode_errors) for r in documents.decoded(df, {"list": "array<int>"}).collect()]
    no = lambda what: (None, [f"list: {what}"])
    assert got == [([1, 2], []), ([1, None], []), no("not JSON"), no("not array"), ([1, None], ["list: not array"]), no("missing"), no("not array"), no("not JSON")]


def test_responses_and_their_items(spark):
    plain = {f"{n}_json": "[]" for n in documents.RESPONSE} | {"evidence_ids_json": '["b", "a"]', "evidence_labels_json": '["E1"]', "evidence_positions_json": "[4]"}
    df = spark.createDataFrame([{"response_id": "r", "abstained": 1, "abstain_enabled": 0, **plain}])
    out = documents.decoded_responses(df)
    r = out.first()
    assert (r.bundle_label, r.bundle_size, r.bundle_signature, r.cluster_id, r.abstained, r.abstain_enabled) == ("E1", 2, "a|b", None, True, False)
    items = documents.response_items(out).orderBy("position").collect()
    assert [(x.evidence_id, x.evidence_label, x.window_id, x.position) for x in items] == [("a", "", "", 1), ("b", "E1", "", 4)]
    assert documents.decoded_responses(df.withColumn("bundle_signature", F.lit("own"))).first().bundle_signature == "own"


def test_event_envelopes(spark):
    rows = [("run:1", 5, "run", "x", 7, ' {"b":2} '), ("window:2:z", 6, "batch", "batch_success", 7, "oops"), ("run:1", 1007, "batch", "other", 8, ""), ("run:", 8, "run", "x", 9, None), ("odd:1", 9, "job", "job_finalized", 9, "1"), ("run:3", 2, "job", "job_finalized", 1, "[]")]
    df = spark.createDataFrame(rows, "trace_id string, event_id long, entity_type string, event_name string, ts_ms long, payload_json string")
    got = documents.event_envelopes(df, "s", "d").collect()
    assert [(r.seq, r.payload_kind, r.payload, r.process_type, r.process_id, r.mirrored) for r in got] == [
        (7005, "json", '{"b":2}', "run", "1", True), (7006, "text", "oops", "window", "2", True), (8007, None, None, "run", "1", False),
        (9008, None, None, None, None, False), (9009, "json", "1", None, None, False), (1002, "json", "[]", "run", "3", True),
    ]
    assert got[0].external_trace_ref == "dataset=d trace_id=run:1" and documents.event_envelopes(df, "s").first().external_trace_ref is None


def test_texts_are_encoded_once(spark, tmp_path):
    log, broken = str(tmp_path / "log"), str(tmp_path / "broken")

    def encoder(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if os.path.exists(broken) and "bad" in texts:
            raise RuntimeError("no more")
        return [[float(len(t)), 1.0] for t in texts]

    asked = lambda: sorted(open(log).read().split()) if os.path.exists(log) else []
    cache = EmbeddingCache(spark, f"{tmp_path}/cache")
    texts = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None)], "i int, t string")
    want = {1: [3.0, 1.0], 2: [5.0, 1.0], 3: [3.0, 1.0], 4: None}
    for _ in range(2):
        assert {r.i: r.embedding for r in cache.embedded(texts, "t", "m", encoder).collect()} == want
    assert asked() == ["one", "three"]
    open(broken, "w").close()
    more = texts.unionByName(spark.createDataFrame([(5, "bad"), (6, "good")], "i int, t string"))
    with pytest.raises(Exception, match="no more"):
        cache.embedded(more, "t", "m", encoder)
    assert {r.i: r.embedding for r in cache.embedded(texts, "t", "m", encoder).collect()} == want
    os.remove(broken)
    assert {r.i: r.embedding for r in cache.embedded(more, "t", "m", encoder).collect()} == want | {5: [3.0, 1.0], 6: [4.0, 1.0]}
    cache.embedded(texts, "t", "other", encoder)
    before, seen = cache.vectors().count(), asked()
    cache.compact()
    assert cache.vectors().count() == before == 6 and {r.i: r.embedding for r in cache.embedded(texts, "t", "m", encoder).collect()} == want and asked() == seen


def test_contracts_bind_snapshots(spark, tmp_path):
    store, rows = SnapshotStore(spark, str(tmp_path)), spark.range(5).withColumnRenamed("id", "x")
    one = store.export("a", "r1", {"responses": rows, "rubrics": rows.limit(2)})
    two = store.export("b", "r2", {"responses": rows.limit(3), "rubrics": rows})
    rows.withColumn("snapshot_id", F.lit("half")).write.mode("append").partitionBy("snapshot_id").parquet(f"{tmp_path}/responses")
    assert store.manifest_of(one)["tables"] == {"responses": 5, "rubrics": 2} and store.required_run(tag="b")["snapshot_id"] == two
    contract = {"snapshot_ids": [one, two], "experiment_tags": ["a", "b"], "export_schema_version": 3, "row_counts": {"responses": 8}}
    assert store.problems(contract) == [] and store.bound(contract, ["responses"])["responses"].count() == 8
    bad = contract | {"snapshot_ids": [one, one, "half"], "export_schema_version": 4, "row_counts": {"responses": 8, "other": 1}}
    assert store.problems(bad) == [f"snapshot named twice: {one}", "snapshot missing or incomplete: half", "tag missing: b", f"schema version 3 of {one}, not 4", "5 rows of responses, not 8", "0 rows of other, not 1"]
    with pytest.raises(ContractError, match="tag missing: b"):
        store.bound(bad, ["responses"])
    with pytest.raises(ContractError):
        store.required_run(tag="a", run_id="r2")
    with pytest.raises(KeyError):
        store.manifest_of("half")
    newer = store.export("a", "r1", {"responses": rows.limit(1), "rubrics": rows}, refresh=True)
    assert store.bundle(["responses"], tags=["a"])["responses"].count() == 1 and store.required_run(run_id="r1")["snapshot_id"] == newer
    assert store.bound(contract, ["responses"])["responses"].count() == 8
    for name in ("first", "second"):
        store.register_artifacts([one, two], name, "table", "t.csv", {"n": 1})
    assert sorted((r.snapshot_id, r.report_name, r.metadata) for r in store.artifacts().collect()) == sorted((s, "second", '{"n": 1}') for s in (one, two))
