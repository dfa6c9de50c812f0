"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts each word from the two words on either side of it: their embeddings, one table for each place, add up to
a hidden layer, and a two-level softmax gives the word's class and then the word in its class. A document's score is the sum of
the log-probabilities of all its words, each given both sides.

The network knows the corpus's commonest words, counted over all documents; a rarer word is one of ``TAILS`` classes of last
bytes, and its probability is that of the class by its share of the class. Shares are the discounted counts of all words seen
twice or more, however many there are; what the discount and the words seen once leave is dealt by spelling, so words that were
never seen have a share too. Training is numpy inside tasks: every task takes one pass over its documents from the same
parameters, at every word, and the parameters are averaged by the words they have seen. They travel in chunks of ``CHUNK``, which
are summed as they come, so memory and the driver hold one set of parameters, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.scratch import written
from assayer.llm.words import LETTERED, Words, slices, words

#: Words and word classes that the network knows; the last TAILS + 1 are rarer words by their ending, and the texts' ends.
VOCABULARY, TAILS, CLASSES, HIDDEN = 1024, 63, 32, 48
SIDE = 2
#: Words of a step of training: a STEPS-th part of a slice of texts, within BATCH.
STEPS, BATCH, RATE = 20, (512, 8192), 0.05
#: Parameters that travel together.
CHUNK = 4096
#: What a rare word's count is discounted by, and what a spelling's count begins at.
DISCOUNT, LEAST = 0.5, 0.1
#: In place of a byte: the word begins. Bytes that words are made of, lower-cased.
_START = 256
_BYTES = np.flatnonzero(LETTERED)


def _tail(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The class of a rare word by its last byte and the one before, which is the same in a word of one."""
    return (last.astype(np.int64) * 31 + before) % TAILS


@dataclass
class Rare:
    """The share of each rare word in its class. Words are spelt backwards: the last two bytes, and then each byte given the next."""

    hash: np.ndarray  # of words seen twice or more, sorted
    count: np.ndarray  # of each of them, discounted
    total: np.ndarray  # (TAILS,), of all words of a class
    left: np.ndarray  # (TAILS,), what the words above leave of a class
    ending: np.ndarray  # (256, 257), log-probability in the class
    step: np.ndarray  # (256, 257)

    @classmethod
    def of(cls, kind: np.ndarray, key: np.ndarray, n: np.ndarray) -> Rare:
        """From the rows of ``_rare_counts``."""

        def counts(k: int, size: int) -> np.ndarray:
            return np.bincount(key[kind == k], n[kind == k], size)

        ending, step = np.zeros((256, 257)), np.zeros((256, 257))
        allowed = np.zeros((256, 257), dtype=bool)
        allowed[np.ix_(_BYTES, np.append(_BYTES, _START))] = True
        last, before = np.divmod(np.arange(256 * 257), 257)
        tail = _tail(last, np.where(before == _START, last, before)).reshape(256, 257)
        ends = (counts(1, 256 * 257).reshape(256, 257) + LEAST) * allowed
        ending[allowed] = np.log((ends / np.bincount(tail.ravel(), ends.ravel(), TAILS)[tail])[allowed])
        steps = (counts(2, 256 * 257).reshape(256, 257) + LEAST) * allowed
        step[allowed] = np.log(steps[allowed] / np.broadcast_to(steps.sum(axis=1, keepdims=True), steps.shape)[allowed])
        total = counts(3, TAILS) + 1
        order = np.argsort(key[kind == 0].view(np.uint64))
        return cls(key[kind == 0].view(np.uint64)[order], n[kind == 0][order] - DISCOUNT, total, (counts(4, TAILS) + DISCOUNT * counts(5, TAILS) + 1) / total, ending, step)

    def log_share(self, w: Words, at: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The log-share in its class ``tail`` of each word ``w[at]``."""
        start, end, hash = w.start[at], w.end[at], w.hash[at]
        # Up to each byte: the log-probabilities of the byte before it, given it.
        steps = np.concatenate([[0, 0], np.cumsum(self.step[w.data[1:], w.data[:-1]])])
        one = end - start == 1
        spelt = self.ending[w.data[end - 1], np.where(one, _START, w.data[np.maximum(end - 2, start)].astype(np.int64))]
        spelt += np.where(one, 0, steps[np.maximum(end - 1, start + 1)] - steps[start + 1] + self.step[w.data[start], _START])
        seen = np.zeros(len(at))
        if len(self.hash):
            place = np.minimum(np.searchsorted(self.hash, hash), len(self.hash) - 1)
            seen = np.where(self.hash[place] == hash, self.count[place], 0.0)
        # A long word's spelling may be less likely than a double can say.
        known = np.log(seen / self.total[tail], where=seen > 0, out=np.full(len(at), -np.inf))
        return np.logaddexp(known, np.log(self.left[tail]) + spelt)


@dataclass
class Network:
    """``known`` holds the sorted hashes of the vocabulary's words, and ``number`` their numbers."""

    known: np.ndarray
    number: np.ndarray
    embed: np.ndarray  # (2 * SIDE, VOCABULARY, HIDDEN)
    bias: np.ndarray  # (HIDDEN,)
    by_class: np.ndarray  # (CLASSES, HIDDEN + 1)
    by_word: np.ndarray  # (CLASSES, VOCABULARY / CLASSES, HIDDEN + 1)
    rare: Rare | None = None

    PARTS = ("embed", "bias", "by_class", "by_word")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.PARTS:
            old = getattr(self, p)
            setattr(self, p, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def hidden(self, context: np.ndarray) -> np.ndarray:
        out = np.ones((len(context), HIDDEN + 1), np.float32)
        z = self.embed[0].take(context[:, 0], axis=0)
        for side in range(1, 2 * SIDE):
            z += self.embed[side].take(context[:, side], axis=0)
        z += self.bias
        np.tanh(z, out=out[:, :HIDDEN])
        return out

    def in_class(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The scores of the words of a class for rows of ``h`` that are sorted by class; ``ends`` parts the classes."""
        out = np.empty((len(h), self.by_word.shape[1]), np.float32)
        for g in range(CLASSES):
            np.matmul(h[ends[g] : ends[g + 1]], self.by_word[g].T, out=out[ends[g] : ends[g + 1]])
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each target word given the words around it."""
        order, ends = _by_class(target)
        h, t, row = self.hidden(context[order]), target[order], np.arange(len(order))
        out = np.empty(len(order))
        out[order] = sum(x[row, at].astype(np.float64) - _log_sum(x) for x, at in ((h @ self.by_class.T, t % CLASSES), (self.in_class(h, ends), t // CLASSES)))
        return out

    def train(self, context: np.ndarray, target: np.ndarray, state: list[np.ndarray]) -> None:
        """One step of adaptive gradient descent on a batch; ``state`` holds the sums of squared gradients by part."""
        order, ends = _by_class(target)
        context, target, row = context[order], target[order], np.arange(len(order))
        h, n = self.hidden(context), len(order)
        p = _softmax(h @ self.by_class.T)
        p[row, target % CLASSES] -= 1
        back = p @ self.by_class[:, :HIDDEN]
        class_grad = p.T @ h
        word_grad = np.zeros_like(self.by_word)
        q = _softmax(self.in_class(h, ends))
        q[row, target // CLASSES] -= 1
        for g in range(CLASSES):
            rows = slice(ends[g], ends[g + 1])
            back[rows] += q[rows] @ self.by_word[g][:, :HIDDEN]
            word_grad[g] = q[rows].T @ h[rows]
        back *= 1 - h[:, :HIDDEN] ** 2
        for side in range(2 * SIDE):
            order = np.argsort(context[:, side].astype(np.uint16), kind="stable")
            near = context[order, side]
            first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            grad, at = np.add.reduceat(back.take(order, axis=0), first) / np.sqrt(n, dtype=np.float32), near[first]
            state[0][side][at] += grad**2
            self.embed[side][at] -= RATE * grad / np.sqrt(state[0][side][at] + 1e-6)
        for part, grad, squares in zip(self.PARTS[1:], (back.sum(axis=0), class_grad, word_grad), state[1:], strict=True):
            grad /= np.sqrt(n)
            squares += grad**2
            getattr(self, part)[...] -= RATE * grad / np.sqrt(squares + 1e-6)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by class, and where each class begins and the last one ends in it."""
    group = (target % CLASSES).astype(np.uint16)  # sorted by radix
    return np.argsort(group, kind="stable"), np.append(0, np.cumsum(np.bincount(group, minlength=CLASSES)))


def _shift(x: np.ndarray) -> np.ndarray | float:
    """What to take from each row before its exponentials: nothing as long as these are far from a float's limits."""
    return 0.0 if not x.size or max(x.max(), -x.min()) < 40 else x.max(axis=1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= _shift(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials, in double precision."""
    shift = _shift(x)
    return np.log((np.exp(x - shift) @ np.ones(x.shape[1], x.dtype)).astype(np.float64)) + np.ravel(shift)


def initial(vocabulary: list[str], seed: int = 4) -> Network:
    """A network before training that knows the given words."""
    w = words(pa.array(vocabulary, pa.string()), LETTERED, lower=True)
    hashes = w.hash[w.first[:-1]] if len(vocabulary) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(size=shape) * 0.05).astype(np.float32)
    return Network(hashes[order], order, small(2 * SIDE, VOCABULARY, HIDDEN), np.zeros(HIDDEN, np.float32), small(CLASSES, HIDDEN + 1), small(CLASSES, VOCABULARY // CLASSES, HIDDEN + 1))


def numbered(column: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts: the words around each, its own number, and where each text's words begin."""
    return _numbered(column, net)[:3]


def _numbered(column: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    w = words(column, LETTERED, lower=True)
    end, tail = VOCABULARY - 1, VOCABULARY - 1 - TAILS
    number = tail + (_tail(w.data[w.end - 1], w.data[np.maximum(w.end - 2, w.start)]) if len(w.start) else np.zeros(0, np.int64))
    if len(net.known) and len(number):
        at = np.minimum(np.searchsorted(net.known, w.hash), len(net.known) - 1)
        number = np.where(net.known[at] == w.hash, net.number[at], number)
    n = len(number)
    begin, stop = np.repeat(w.first[:-1], np.diff(w.first)), np.repeat(w.first[1:], np.diff(w.first))
    context = np.full((n, 2 * SIDE), end)
    for side, step in enumerate([s for s in range(-SIDE, SIDE + 1) if s]):
        at = np.arange(n) + step
        inside = (at >= begin) & (at < stop)
        context[inside, side] = number[at[inside]]
    return context, number, w.first, w


def _train(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = network.value
        start = net.flat()
        net.load(start)
        state = [np.full(getattr(net, p).shape, 1e-2, np.float32) for p in net.PARTS]
        rng, seen = np.random.default_rng(4), 0
        for batch in batches:
            for part in slices(batch, "text"):
                context, target, _ = numbered(part.column("text"), net)
                at = rng.permutation(len(target))
                size = min(max(len(at) // STEPS, BATCH[0]), BATCH[1])
                for a in range(0, len(at), size):
                    net.train(context[at[a : a + size]], target[at[a : a + size]], state)
                seen += len(at)
        moved = net.flat()
        net.load(start)  # the worker may run another task with it
        if seen:
            parts = [moved[a : a + CHUNK].astype(np.float32).tobytes() for a in range(0, len(moved), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), seen))], ["chunk", "mean", "words"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each chunk, weighted by words, from rows that are summed one by one."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            total, words_ = sums.get(row["chunk"], (0.0, 0))
            sums[row["chunk"]] = total + np.frombuffer(row["mean"], np.float32).astype(np.float64) * row["words"], words_ + row["words"]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(t / n).astype(np.float32).tobytes() for t, n in sums.values()], pa.binary())], ["chunk", "mean"])


def _counts(docs: DataFrame, text: str) -> DataFrame:
    # Splitting at one character is several times as fast as at a pattern: what parts words becomes a space on the way.
    parts = "".join(chr(b) for b in range(128) if not LETTERED[b] and not 65 <= b <= 90)
    plain = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + parts, "abcdefghijklmnopqrstuvwxyz" + " " * len(parts))
    return docs.select(F.explode(F.split(plain, " ")).alias("w")).where("w <> ''").groupBy("w").count()


def _commonest(counts: DataFrame) -> list[str]:
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(VOCABULARY - 1 - TAILS).collect()]


def vocabulary(docs: DataFrame, text: str = "text") -> list[str]:
    """The commonest words of all texts, lower-cased A-Z; of equal counts the smaller word."""
    return _commonest(_counts(docs, text))


def _rare_counts(network):
    """Of the words that the network doesn't know, by ``kind``: 0 the count of each that was seen twice or more, by hash;
    1 endings and 2 steps of spelling, each word once; 3 words of a class, 4 those seen once, 5 different ones of kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "w"):
                _, number, _, w = _numbered(part.column("w"), network.value)
                n = part.column("count").to_numpy()
                tail = number - (VOCABULARY - 1 - TAILS)
                rare = tail >= 0
                n, tail, start, end, hash = n[rare], tail[rare], w.start[rare], w.end[rare], w.hash[rare]
                more, data = n > 1, w.data.astype(np.int64)
                ending = data[end - 1] * 257 + np.where(end - start == 1, _START, data[np.maximum(end - 2, start)])
                size = np.maximum(end - start - 2, 0)
                at = np.repeat(start + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
                long = start[end - start > 1]
                step = np.concatenate([data[at] * 257 + data[at - 1], data[long] * 257 + _START])
                found = [(0, hash[more].view(np.int64), n[more])]
                for kind, key, weight in ((1, ending, None), (2, step, None), (3, tail, n), (4, tail[~more], None), (5, tail[more], None)):
                    sums = np.bincount(key, weight)
                    found.append((kind, np.flatnonzero(sums), sums[sums > 0].astype(np.int64)))
                kinds = np.repeat([k for k, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2))], ["kind", "key", "n"])

    return run


def fit(docs: DataFrame, text: str = "text") -> Network:
    """The network of all texts. Without words it is the untrained one."""
    spark = docs.sparkSession
    counts = written(_counts(docs, text), "words")
    net = initial(_commonest(counts))
    source = docs.select(F.col(text).alias("text")).where("text is not null")
    moved = source.mapInArrow(_train(spark.sparkContext.broadcast(net)), "chunk int, mean binary, words long")
    mean = moved.repartition(-(-len(net.flat()) // CHUNK), "chunk").mapInArrow(_average, "chunk int, mean binary").orderBy("chunk").toArrow()
    if len(mean):
        net.load(np.frombuffer(b"".join(mean.column("mean").to_pylist()), np.float32))
    rare = counts.mapInArrow(_rare_counts(spark.sparkContext.broadcast(net)), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    net.rare = Rare.of(*(rare.column(c).to_numpy() for c in ("kind", "key", "n")))
    return net


def _score(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                context, target, first, w = _numbered(part.column("text"), network.value)
                each = np.concatenate([network.value.log_probability(context[a : a + 8192], target[a : a + 8192]) for a in range(0, len(target), 8192)] or [np.zeros(0)])
                at = np.flatnonzero(target >= VOCABULARY - 1 - TAILS)
                if network.value.rare is not None and len(at):
                    each[at] += network.value.rare.log_share(w, at, target[at] - (VOCABULARY - 1 - TAILS))
                sums = np.concatenate([[0], np.cumsum(each)])
                n = np.diff(first)
                total = sums[first[1:]] - sums[first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int64)), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], ["id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return run


def score(docs: DataFrame, network: Network, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, log_likelihood, mean_log_likelihood``.

    The likelihood is the sum over all words of the whole text; the mean is null without words, as for null and empty texts,
    whose sum is 0. Null and repeated ids are rows like any other. Other columns of ``docs`` are not read.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    out = source.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(network)), "id long, n_words long, log_likelihood double, mean_log_likelihood double")
    return out.withColumnRenamed("id", id)
