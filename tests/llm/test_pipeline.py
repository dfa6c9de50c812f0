import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees beside the quiet river"
FR = "le petit chat noir dort sous la grande table pendant que les enfants jouent dans le jardin avec leurs amis du village"


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text))


@pytest.fixture
def stages():
    return dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_each_stage_takes_its_cases_and_leaves_the_rest(spark, stages, tmp_path):
    other = " ".join(f"unique{i}" for i in range(40))
    docs = spark.createDataFrame([row(1, EN), row(2, FR, "fr"), row(3, "12 34 ?"), row(4, None), row(5, EN + "\n" + other), row(6, EN.replace("seven", "eight"))], SCHEMA)
    spark.createDataFrame([(9, " ".join(other.split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stages["language_id"](spark, docs, "")
    assert ids(got) == [1, 2, 5, 6] and got.columns == docs.columns
    got = stages["line_dedup"](spark, got, "")
    assert ids(got) == [1, 2, 5] and {r.doc_id: (r.text, r.n_chars) for r in got.collect()}[5] == (other, len(other))
    near = stages["near_dedup"](spark, spark.createDataFrame([row(1, other), row(2, other), row(3, other + " more"), row(4, EN), row(5, "")], SCHEMA), "")
    assert ids(near) == [1, 4, 5] and near.columns == docs.columns
    clean = stages["decontamination"](spark, got, str(tmp_path))
    assert ids(clean) == [1, 2] and clean.columns == docs.columns
    assert {r.doc_id for r in stages["packing"](spark, clean, "").collect()} == {1, 2}


def test_letters_at_random_are_in_no_language(spark, stages):
    rng = random.Random(3)
    words = [EN.split(), FR.split()]
    rows = [row(i, " ".join(rng.choices(words[i % 2], k=rng.choice([3, 30, 300]))), ("en", "fr")[i % 2]) for i in range(300)]
    junk = [row(1000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=500)), None) for i in range(5)]
    assert ids(stages["language_id"](spark, spark.createDataFrame(rows + junk, SCHEMA), "")) == [*range(300)]


def test_run_and_empty_tables(spark, stages, tmp_path):
    spark.createDataFrame([row(1, EN), row(2, FR, "fr"), row(3, EN)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}
    none = spark.createDataFrame([], SCHEMA)
    for stage in stages.values():
        assert stage(spark, none, str(tmp_path)).count() == 0
