"""Benchmark items in training documents, by suffix arrays of the training text.

The training text is cut into shards of about ``SHARD_BYTES``; each shard's words get a suffix array, sorted by prefix
doubling. Every suffix of the benchmark is binary-searched in every shard, which gives its verbatim matches, their places,
and, extended from word to word, the longest of them. A document is affected if a match has ``window`` words or is a whole
item of fewer.

The benchmark is cut into blocks of ``BLOCK_BYTES``, of which one at a time is with the driver and the tasks; a larger benchmark
takes more passes, not more memory, each of which is written before the next block is sent. Nothing but the affected words'
places is exchanged, and with one block nothing at all.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.scratch import written
from assayer.llm.words import LETTERED, Words, slices, words

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each key's rank among the distinct ones."""
    order = np.argsort(key)
    new = np.ones(len(key), dtype=np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def ranks(hashes: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` words, where a text's end is smaller than any word.

    Sorting by it gives the suffix array to that depth. Ranks come from prefix doubling; those of depths between two powers
    from two overlapping halves.
    """
    _, rank = _ranked(hashes)
    end = np.repeat(first[1:], np.diff(first))
    at, done = np.arange(len(hashes)), 1
    while done < depth:
        step = min(done, depth - done)
        after = np.where(at + step < end, rank[np.minimum(at + step, len(rank) - 1)], 0) if len(rank) else rank
        _, rank = _ranked(rank << np.int64(32) | after)
        done += step
    return rank


class Benchmark:
    """A block of items: their words, and the suffixes that have a window to look for."""

    def __init__(self, ids: list, texts: list, window: int):
        w = words(pa.array(texts, pa.string()), LETTERED, lower=True)
        self.ids, self.hash, self.first = ids, w.hash, w.first
        n = np.diff(w.first)
        self.length = np.minimum(n, window)
        item = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, n > 0))
        start = np.concatenate([[0], np.cumsum(np.maximum(n - window + 1, n > 0))])
        self.item = item
        self.at = w.first[item] + np.arange(len(item)) - start[item]


def matches(w: Words, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All matches of the block's windows in a shard: the window's place in the block, the word where it starts, its words."""
    hashes = np.concatenate([w.hash, bench.hash])
    first = np.concatenate([w.first, bench.first[1:] + len(w.hash)])
    found = []
    for length in np.unique(bench.length[bench.item]):
        rank = ranks(hashes, first, int(length))
        train, tests = rank[: len(w.hash)], np.flatnonzero(bench.length[bench.item] == length)
        array = np.argsort(train)  # the shard's suffix array
        low = np.searchsorted(train, rank[len(w.hash) + bench.at[tests]], "left", array)
        high = np.searchsorted(train, rank[len(w.hash) + bench.at[tests]], "right", array)
        n = high - low
        place = array[np.repeat(low - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
        found.append((np.repeat(tests, n), place, np.full(len(place), length)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def longest(test: np.ndarray, place: np.ndarray, length: np.ndarray, bench: Benchmark) -> list[tuple[int, int, int]]:
    """Maximal matches as (item, first word, words): windows of an item that follow one another at following places are one."""
    if not len(test):
        return []
    shift = place - bench.at[test]
    order = np.lexsort((place, shift, bench.item[test]))
    item, shift, place, length = bench.item[test][order], shift[order], place[order], length[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] != place[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(item)) - 1
    return [(int(item[a]), int(place[a]), int(place[b] - place[a] + length[b])) for a, b in zip(at, last, strict=True)]


_FOUND = "id long, row long, n_words long, spans array<struct<item: string, start: long, length: long>>"
_SPANS = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def _search(block, window: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*block.value, window)
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                w = words(part.column("text"), LETTERED, lower=True)
                spans: list[list[dict]] = [[] for _ in range(len(w))]
                for item, start, length in longest(*matches(w, bench), bench):
                    doc = int(np.searchsorted(w.first, start, "right")) - 1
                    spans[doc].append({"item": bench.ids[item], "start": start - int(w.first[doc]), "length": length})
                keep = np.array([every or bool(s) for s in spans])
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("row").take(at), pa.array(np.diff(w.first).astype(np.int64)).take(at), pa.array([s for s, k in zip(spans, keep, strict=True) if k], _SPANS)],
                    ["id", "row", "n_words", "spans"],
                )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, items = [], []
        for spans in batch.column("spans").to_pylist():
            edges = sorted((s["start"], s["start"] + s["length"]) for s in spans)
            hit = end = 0
            for a, b in edges:
                hit += max(0, b - max(a, end))
                end = max(end, b)
            hits.append(hit)
            items.append(sorted({s["item"] for s in spans if s["item"] is not None}))
        shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "row", "n_words")), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas), batch.column("spans")],
            ["id", "row", "n_words", "n_hit", "n_items", "items_sha256", "spans"],
        )


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).toLocalIterator():
        ids.append(r["item"])
        texts.append(r["text"])
        held += len((r["text"] or "").encode())
        if held >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` lists the longest matches: the item, the document's first word and the words. ``n_hit`` counts the document's words
    in them. An item without words matches nothing; one without an id marks words, but isn't named or counted. Null texts have
    no words. Repeated rows of either table count each for itself, repeated item ids once. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    blocks = _blocks(benchmark, item, item_text)
    block, then = next(blocks), next(blocks, None)
    if then is None:
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(block), window, True), _FOUND)
    else:
        docs = written(docs, "numbered")  # every pass must see the same row numbers
        passes: list[DataFrame] = []
        while block is not None:
            sent = spark.sparkContext.broadcast(block)
            passes.append(written(docs.mapInArrow(_search(sent, window, not passes), _FOUND), "found"))
            sent.destroy()
            block, then = then, next(blocks, None)
        found = functools.reduce(DataFrame.unionByName, passes)
        found = found.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    out = found.select("id", "row", "n_words", "spans").mapInArrow(_digest, "id long, row long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<item: string, start: long, length: long>>")
    return out.select(F.col("id").alias(id), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def _clean(block, window: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*block.value, window)
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                w = words(part.column(text), LETTERED, lower=True)
                keep = np.ones(len(w), dtype=bool)
                _, place, _ = matches(w, bench)
                keep[np.searchsorted(w.first, place, "right") - 1] = False
                yield part.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with every column.

    Null and empty texts hold none and stay, as do all rows if the benchmark has no words. Repeated rows are judged each for
    itself. No column is added, so names cannot clash. With several blocks what a pass keeps is written before the next.
    """
    blocks, context = _blocks(benchmark, item, item_text), docs.sparkSession.sparkContext
    block = next(blocks)
    while (then := next(blocks, None)) is not None:
        sent = context.broadcast(block)
        docs = written(docs.mapInArrow(_clean(sent, window, text), docs.schema), "clean")
        sent.destroy()
        block = then
    return docs.mapInArrow(_clean(context.broadcast(block), window, text), docs.schema)
