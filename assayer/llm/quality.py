"""A quality classifier of supervised subword embeddings.

A document's features are its words, pairs of neighbouring words and the ``GRAMS``-byte grams inside words, edges included, hashed to
``BUCKETS``; pairs of a word with itself are all one feature. Each bucket has a learned vector; a document is the average of its features' vectors, and a softmax over the two classes is taken of a linear map of
that average. Vectors and map are trained together by stochastic gradient descent, one document at a step, in an order drawn from a
fixed seed.

Only the training sees a sample: at most ``SAMPLE`` documents of each class, those with the smallest hashes of their ids. The classes'
shares among all labelled documents correct the scores for that. Scoring reads every whole text. As the map is linear, it is applied to
the vectors beforehand, so a document's score takes one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.words import SPACED, mixed, slices, words

GRAMS, BUCKETS, DIMENSIONS = (2, 3, 4), 1 << 16, 16
#: Labelled documents of each class that are learned from, at most.
SAMPLE = 2000
REPEATED = mixed(np.array([1], np.uint64))[0]
EPOCHS, RATE = 8, 0.2
#: The vectors' rate as a multiple of RATE: a feature's share of a document, and with it its gradient, is small.
VECTOR_RATE = 40


@dataclass
class QualityModel:
    """``vectors[b]`` is a bucket's vector, ``head`` the map to the two classes; ``offset`` is added to the log-odds of class 1."""

    vectors: np.ndarray
    head: np.ndarray
    offset: float

    def weights(self) -> np.ndarray:
        """What each bucket adds to the log-odds of class 1, before averaging."""
        return self.vectors @ (self.head[:, 1] - self.head[:, 0])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of every occurrence of a feature, by ascending text within each kind; and how many each text has."""
    w = words(column, SPACED)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    texts = np.arange(len(w))
    docs, buckets = [np.repeat(texts, np.diff(w.first))], [(w.hash >> shift).astype(np.int32)]
    one, two, near = w.hash[:-1], w.hash[1:], docs[0][:-1] == docs[0][1:]
    docs.append(docs[0][:-1][near])
    buckets.append((np.where(one == two, REPEATED, mixed(one * np.uint64(3) + two))[near] >> shift).astype(np.int32))
    # Words one after another with a space before each and after the last, so that grams see the edges of words.
    length = w.end - w.start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    flat = np.full(at[-1] + 1, 32, np.uint32)
    inside = np.ones(at[-1] + 1, bool)
    inside[at] = False
    source = np.zeros(len(w.data) + 1, np.int32)
    source[w.start] += 1
    np.add.at(source, w.end, -1)
    flat[inside] = w.data[np.cumsum(source[:-1]).astype(bool)]
    doc = np.append(np.repeat(docs[0], length + 1), -1)
    for n in GRAMS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        whole = np.ones(m, bool)
        for i in range(n):
            h = (h ^ flat[i : i + m]) * np.uint32(0x01000193)
            if 0 < i < n - 1:
                whole &= inside[i : i + m]
        whole &= doc[:m] >= 0
        docs.append(doc[:m][whole])
        buckets.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)[whole])
    return np.concatenate(docs), np.concatenate(buckets), sum(np.bincount(d, minlength=len(w)) for d in docs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            doc, bucket, _ = features(part.column("text"))
            key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(part) + 1) * BUCKETS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % BUCKETS, n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *lists], ["doc_id", "label", "bucket", "n"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, offset: float, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> QualityModel:
    """Fits the model to bags of buckets and their counts. The rate falls evenly to nothing."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    head = np.zeros((DIMENSIONS, 2))
    steps = epochs * len(bags)
    for step, i in enumerate(np.concatenate([rng.permutation(len(bags)) for _ in range(epochs)]) if len(bags) else ()):
        bucket, n = bags[i]
        if not len(bucket):
            continue
        share = n / n.sum()
        mean = share @ vectors[bucket]
        logits = mean @ head
        p = np.exp(logits - logits.max())
        error = -p / p.sum()
        error[labels[i]] += 1
        error *= rate * (1 - step / steps)
        toward = head @ error
        head += np.outer(mean, error)
        vectors[bucket] += np.outer(VECTOR_RATE * share, toward)
    return QualityModel(vectors, head, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """The model of ``docs`` (``doc_id, text``) whose ids have a label 0 or 1 in ``labels``.

    Null labels and ids teach nothing, nor do ids with both labels; an id that several documents share stands for the greatest text.
    If a class has no document, all scores are that of the other's share, and one half without any label. The driver gets at most
    ``2 * sample`` rows of at most ``BUCKETS`` counts.
    """
    kinds = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_most"))
    kinds = kinds.where(F.col("label") == F.col("_most")).select("doc_id", "label")
    learned = kinds.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    count = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if len(count) < 2:
        return QualityModel(np.zeros((BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 2)), 0.0 if not count else 4.0 if 1 in count else -4.0)
    first = lambda k: learned.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(0).unionByName(first(1))
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))  # 2 * sample ids
    rows = texts.mapInArrow(_counted, "doc_id long, label int, bucket array<int>, n array<int>").toArrow().sort_by("doc_id")
    bags = [(b.values.to_numpy(), n.values.to_numpy()) for b, n in zip(rows.column("bucket"), rows.column("n"), strict=True)]
    kept = {k: min(sample, n) for k, n in count.items()}
    offset = float(np.log(count[1] / count[0]) - np.log(kept[1] / kept[0]))
    return train(bags, rows.column("label").to_numpy(), offset)


def _score(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                doc, bucket, n = features(part.column("text"))
                odds = np.bincount(doc, weights[bucket], len(part)) / np.maximum(n, 1) + offset
                score = pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))
                yield pa.RecordBatch.from_arrays([*part.column("row").flatten(), score], [*keep, "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and ``score``, the probability of label 1 by its whole ``text``.

    A null or empty text, or one of white space, has no feature: its score is that of the classes' shares.
    """
    keep = [c for c in keep if c != "score"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast((model.weights(), model.offset)), keep), schema)
