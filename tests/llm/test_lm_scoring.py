import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm.lm_scoring import CLASSES, SIDE, TAILS, VOCABULARY, _counts, _log_sum, _softmax, _train, fit, initial, numbered, score, vocabulary
from assayer.llm.words import LETTERED, words


def sentence(rng, n):
    """Words that follow one another in a ring, so that neighbours tell which one is meant."""
    at = rng.integers(0, 40)
    return " ".join(f"w{(at + i) % 40}" for i in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(1)
    return fit(spark.createDataFrame([(sentence(rng, 200),) for _ in range(300)] + [(None,), ("",)], "text string").repartition(3))


def by_hand(net, text):
    """The pseudo-likelihood with a full softmax over all words, one place after another."""
    _, number, _ = numbered(pa.array([text]), net)
    total = 0.0
    for i, t in enumerate(number):
        around = [number[i + s] if 0 <= i + s < len(number) else VOCABULARY - 1 for s in range(-SIDE, SIDE + 1) if s]
        h = np.append(np.tanh(net.bias + sum(net.embed[k][c] for k, c in enumerate(around))), 1)
        group = np.exp(net.by_class @ h)
        inner = np.exp(net.by_word[t % CLASSES] @ h)
        total += np.log(group[t % CLASSES] / group.sum()) + np.log(inner[t // CLASSES] / inner.sum())
    return total


def test_scores_equal_those_by_hand_and_prefer_fluent_texts(spark, trained):
    rng = np.random.default_rng(2)
    texts = [sentence(rng, 50) for _ in range(10)]
    shuffled = [" ".join(rng.permutation(t.split())) for t in texts]
    got = {r.doc_id: r for r in score(spark.createDataFrame([*enumerate(texts + shuffled)], "doc_id long, text string"), trained).collect()}
    assert all(abs(got[i].log_likelihood - by_hand(trained, t)) < 1e-2 for i, t in enumerate(texts + shuffled))
    assert all(got[i].log_likelihood > got[i + 10].log_likelihood + 20 for i in range(10))
    assert np.mean([got[i].mean_log_likelihood for i in range(10)]) > np.log(1 / 40) + 0.5  # better than word frequencies alone


def test_probabilities_sum_to_one():
    net = initial(["a", "b"])
    context = np.zeros((VOCABULARY, 2 * SIDE), dtype=np.int64)
    assert abs(np.exp(net.log_probability(context, np.arange(VOCABULARY))).sum() - 1) < 1e-4


def test_edge_cases(spark, trained):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "w1"), (None, "unseen Words ünd"), (5, "w1 " * 50000), (4, "w1")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in score(docs, trained).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 4, None, 5)] == [0, 0, 0, 1, 3, 50000]
    assert got[1].log_likelihood == 0 and got[1].mean_log_likelihood is None and got[4].log_likelihood < 0
    assert score(docs.limit(0), trained).count() == 0
    assert vocabulary(docs.where("doc_id = 5")) == ["w1"] and fit(docs.where("doc_id = 2")).known.size == 0


def test_rare_words_have_a_share_of_their_class(spark):
    rng = np.random.default_rng(3)
    common, rare = [f"k{i:03}" for i in range(960)], [f"{a}{b}{c}e" for a in "abcd" for b in "aeiou" for c in "lmn"] + ["x", "ab"]
    often = {x: 2 + i for i, x in enumerate(rare)} | {"once": 1}
    text = [x for w, n in ({w: 200 for w in common} | often).items() for x in [w] * n]
    net = fit(spark.createDataFrame([(" ".join(x),) for x in np.array_split(rng.permutation(text), 6)], "text string"))
    assert len(net.known) == 960 and set(net.rare.count + 0.5) == set(range(2, 64))
    # All strings of up to two bytes, what was seen, and some that were not: a class has no more than 1 to share out.
    alphabet = [chr(b) for b in np.flatnonzero(LETTERED) if b < 128]
    every = sorted({*alphabet, *(a + b for a in alphabet for b in alphabet), *often, "zzzqe", "q" * 3000})
    w = words(pa.array(every), LETTERED, lower=True)
    tail = numbered(pa.array(every), net)[1] - (VOCABULARY - 1 - TAILS)
    share = net.rare.log_share(w, np.arange(len(every)), tail)
    assert np.isfinite(share).all() and np.bincount(tail, np.exp(share), TAILS).max() <= 1 + 1e-9
    by = dict(zip(every, np.exp(share)))
    n = sum(often[x] for x, t in zip(every, tail) if x in often and t == tail[every.index("dune")])
    assert (often["dune"] - 0.5) / (n + 1) <= by["dune"] <= (often["dune"] + 0.5) / n
    # An invented word is less likely than any known one in its place.
    docs = [(i, f"k001 k002 {x} k003 k004") for i, x in enumerate(["k500", "dune", "zzzqe", "q7é9xe"])]
    got = {r.doc_id: r.log_likelihood for r in score(spark.createDataFrame(docs, "doc_id long, text string"), net).collect()}
    assert min(got[0], got[1]) > max(got[2], got[3]) + 3


def test_training_sees_every_word():
    class Sent:
        value = initial(["a", "b"])

    texts = ["a b c d e f g", None, "", "x " * 5000, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    (out,) = _train(Sent)(iter([batch]))
    assert set(out.column("words").to_pylist()) == {7 + 5000 + 1}
    assert sum(len(x) for x in out.column("mean").to_pylist()) == 4 * len(Sent.value.flat())


def test_every_ascii_character_but_letters_and_digits_parts_words(spark):
    text = "".join(f"Ab{chr(b)}" for b in range(128)) + "É\u00a0x"
    want = Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    docs = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert {r["w"]: r["count"] for r in _counts(docs, "text").collect()} == want


def test_softmax_of_small_and_large_scores():
    for x in ([[1, 2, 3], [0, 0, 0]], [[1000, 0, -1000], [-500, -500, -500]], np.zeros((0, 3))):
        x = np.array(x, np.float32)
        top = x.max(axis=1, keepdims=True, initial=-1e9).astype(float)
        sums = np.exp(x - top).sum(axis=1, keepdims=True)
        assert np.allclose(_log_sum(x), (np.log(sums) + top).ravel())
        assert np.allclose(_softmax(x.copy()), np.exp(x - top) / sums, atol=1e-6)
