import numpy as np
import pyarrow as pa
import pytest

from assayer.llm.language_id import LanguageModel, fit_languages, grams, identify, mixtures

WORDS = {"aa": ["lorra", "mendo", "sulak", "irido"], "bb": ["gechte", "waßser", "übung", "klopf"], "cc": ["quelle", "étoile", "maison", "jardin"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(8)
    rows = [(sentence(rng, lang, 40), lang) for lang in WORDS for _ in range(30)] + [(None, "aa"), ("no label", None), ("", "bb")]
    return fit_languages(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_texts_and_mixtures(spark, model):
    rng = np.random.default_rng(9)
    rows = [(i, sentence(rng, lang, 12), lang) for i, lang in enumerate([*WORDS] * 20)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 < r.score <= 1 for r in got)
    both = mixtures(pa.array([sentence(rng, "aa", 60) + " " + sentence(rng, "cc", 30)]), model)[0][0]
    assert both[1] == 0 and abs(both[0] - 2 / 3) < 0.1 and abs(both.sum() - 1) < 1e-3


def test_grams_equal_those_of_each_text_alone():
    texts = ["Abc défg!", None, "", "x", "12 34", "the the the"]
    doc, bucket, count = grams(pa.array(texts))
    for i, t in enumerate(texts):
        _, b, c = grams(pa.array([t]))
        assert bucket[doc == i].tolist() == b.tolist() and count[doc == i].tolist() == c.tolist()


def test_edge_cases(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 34 56"), (None, "mendo sulak irido"), (5, "mendo " * 20000), (6, "ü")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model, keep=["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0) and got[None][0] == got[5][0] == "aa" and got[6][0] != "und"
    empty = fit_languages(docs.selectExpr("text", "cast(null as string) lang"))
    assert empty.languages == [] and {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0 and isinstance(model, LanguageModel)


def test_strange_texts(spark):
    rng = np.random.default_rng(4)
    lists = {lang: ["".join(rng.choice([*letters], rng.integers(3, 8))) for _ in range(80)] for lang, letters in (("aa", "abcdefghi"), ("bb", "éaourstnm"))}
    say = lambda lang, n: " ".join(rng.choice(lists[lang], n))
    model = fit_languages(spark.createDataFrame([(say(lang, 300), lang) for lang in lists for _ in range(60)], "text string, lang string"))
    clean = [say(lang, n) for lang in lists for n in (1, 2, 5, 40, 3000) for _ in range(12)] + [say("aa", 30) + " " + say("bb", 30), say("aa", 40) + " 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", say("aa", 9).upper(), "x", "qq", "", None]
    junk = ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 300)) for _ in range(9)] + ["QmFzZTY0IGVuY29kZWQgc3RyaW5n" * 9]
    assert not mixtures(pa.array(clean), model)[1].any() and mixtures(pa.array(junk), model)[1].all()
    docs = spark.createDataFrame([(1, junk[0], 5), (2, clean[5], 6)], "doc_id long, text string, `r.x` int")
    assert {r.doc_id: (r.strange, r["r.x"]) for r in identify(docs, model).collect()} == {1: (True, 5), 2: (False, 6)}
