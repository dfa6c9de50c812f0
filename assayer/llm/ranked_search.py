"""Ranked search by words, over dual-sorted wavelet trees.

The documents are cut into shards. A shard holds one sequence: the postings of all its terms, one list after the other, each by
falling impact on the score, and in it the documents' numbers in the shard, by ascending doc_id. A wavelet tree over that
sequence sorts it the other way: it is a binary trie of the numbers, and each node keeps the order of the postings below it, so a
term's list is a range in every node and that range's first posting has the list's largest impact among the node's documents. The
tree is kept level by level as bits; a range goes down a level by two counts of ones.

A search holds a frontier of nodes for each query. A node's bound is the sum of the largest impacts of the query's terms in it; a
leaf is one document, and its bound is the score. Each round takes from each query's frontier the nodes with the largest bounds, parts
them, and drops what can't reach the k-th best score. Nothing that could is dropped, so the result is exact. Shards that a task reads one
after another share the best scores found so far.

Impacts need the corpus's size, so that is counted first. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.scratch import written
from assayer.llm.words import LETTERED, slices, word_counts, words

SHARD_BYTES = 12 << 20
#: Rows (a query and a term) of a block of queries, which goes to every task; a query is not cut.
BLOCK_TERMS = 1 << 18
#: Nodes of a query that a round parts.
WIDTH = 64
#: By how much an occurrence in a document of mean length counts.
SCALE, PER_TF, PER_LENGTH = 1_000_000_000, 1000, 8

_INDEX = "docs binary, unnamed int, hashes binary, starts binary, impacts binary, zeros array<int>, bits array<binary>"
_NO_ID = np.iinfo(np.int64).max


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    w = words(batch.column("text"), LETTERED, lower=True)
    return w.hash, w.first


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = total = 0
    for batch in batches:
        for part in slices(batch, "text"):
            n = word_counts(part.column("text"), LETTERED, lower=True)
            some, total = some + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["n", "l"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have, with repeats."""
    row = docs.select("text").mapInArrow(_sizes, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n: int, l: int) -> np.ndarray:  # noqa: E741
    """Part of the score that doesn't depend on the query, in whole numbers: below a million."""
    if 75 * n * int(length.max(initial=0)) >= 2**63:
        m = np.array([25 + 75 * int(x) * n // l for x in length], dtype=np.int64)
    else:
        m = 25 + 75 * length.astype(np.int64) * n // max(l, 1)
    return SCALE * tf.astype(np.int64) // (PER_TF * tf + PER_LENGTH * m)


def build_shard(doc_id: np.ndarray, hashes: np.ndarray, first: np.ndarray, n: int, l: int) -> dict:  # noqa: E741
    """The tree of documents that each have ``hashes[first[d]:first[d + 1]]``, by ascending doc_id."""
    docs, length = len(doc_id), np.diff(first)
    terms, term = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(docs), length)
    key, tf = np.unique(term.astype(np.uint64) * np.uint64(docs) + doc.astype(np.uint64), return_counts=True)
    term, doc = (key // np.uint64(docs)).astype(np.int64), (key % np.uint64(docs)).astype(np.int64)
    impact = impacts(tf, length[doc], n, l)
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    wide = docs.bit_length()
    if len(terms).bit_length() + 20 + wide <= 64:  # term, falling impact and document in one number
        key = np.sort((term << 20 | ((1 << 20) - 1 - impact)).astype(np.uint64) << np.uint64(wide) | doc.astype(np.uint64))
        sequence = (key & np.uint64((1 << wide) - 1)).astype(np.int64)
        impact = ((1 << 20) - 1 - (key >> np.uint64(wide) & np.uint64((1 << 20) - 1)).astype(np.int64)).astype(np.int32)
    else:
        order = np.lexsort((doc, -impact, term))
        sequence, impact = doc[order], impact[order].astype(np.int32)
    bits, zeros = [], []
    for level in range(max(docs - 1, 0).bit_length() - 1, -1, -1):
        b = (sequence >> level) & 1
        bits.append(np.packbits(b.astype(bool)).tobytes())
        zeros.append(int(len(b) - b.sum()))
        sequence = np.concatenate([sequence[b == 0], sequence[b == 1]])
    return {"docs": doc_id, "hashes": terms, "starts": starts, "impacts": impact, "zeros": zeros, "bits": bits}


def _build(n: int, l: int, limit: int):  # noqa: E741
    def shard(held: list[tuple]) -> pa.RecordBatch:
        ids, hashes, length = (np.concatenate([h[i] for h in held]) for i in range(3))
        none = np.concatenate([h[3] for h in held])
        order = np.lexsort((ids, none))  # rows without an id last
        starts = np.concatenate([[0], np.cumsum(length)])
        first = np.concatenate([[0], np.cumsum(length[order])])
        at = np.arange(first[-1]) + np.repeat(starts[order] - first[:-1], length[order])
        s = build_shard(ids[order], hashes[at], first, n, l)
        flat = (s["docs"].astype(np.int64), None, s["hashes"], s["starts"].astype(np.int32), s["impacts"])
        cells = [pa.array([int(none.sum())], pa.int32()) if x is None else pa.array([x.tobytes()], pa.binary()) for x in flat]
        return pa.RecordBatch.from_arrays([*cells, pa.array([s["zeros"]], pa.list_(pa.int32())), pa.array([s["bits"]], pa.list_(pa.binary()))], ["docs", "unnamed", "hashes", "starts", "impacts", "zeros", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = _terms(part)
                length = np.diff(first)
                some = length > 0
                ids = part.column("doc_id")
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False)[some], hashes, length[some], np.asarray(ids.is_null())[some]))
                size += part.column("text").nbytes
                if size >= limit:
                    if sum(len(h[0]) for h in held):
                        yield shard(held)
                    held, size = [], 0
        if sum(len(h[0]) for h in held):
            yield shard(held)

    return run


def build_index(docs: DataFrame, size: tuple[int, int], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row a shard: ``docs`` by ascending doc_id, the last ``unnamed`` without one; hashes and ``starts`` of the terms' lists, their root
    ``impacts``, and of each level the bits and the number of ``zeros``. Arrays are stored as their bytes.

    Every row of ``docs`` with a term is in one shard; ``size`` is ``corpus_size`` of all documents. A shard holds ``shard_bytes`` of
    text of one input partition, or one longer document.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_build(*size, shard_bytes), _INDEX)


class Tree:
    """A shard as a task searches it: counts of ones before each bit, and the impacts in each level's order."""

    def __init__(self, row: dict):
        self.docs, self.hashes, self.starts, root = (np.frombuffer(row[c], t) for c, t in (("docs", np.int64), ("hashes", np.uint64), ("starts", np.int32), ("impacts", np.int32)))
        self.docs = np.where(np.arange(len(self.docs)) < len(self.docs) - row["unnamed"], self.docs, _NO_ID)
        self.zeros, self.ones, self.impacts = row["zeros"], [], [root]
        for packed in row["bits"]:
            level = self.impacts[-1]
            b = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(level)).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int32)]))
            self.impacts.append(np.concatenate([level[~b], level[b]]))

    def lists(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the terms the shard has, and their ranges at the root."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        has = self.hashes[at] == hashes
        return has, self.starts[at[has]].astype(np.int64), self.starts[at[has] + 1].astype(np.int64)


def _grouped(group: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)


class Best:
    """The k best documents of each query so far: highest score first, equal ones by ascending doc_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.score, self.doc = k, *(np.zeros(0, np.int64),) * 3
        self.least, self.last = np.zeros(queries, np.int64), np.full(queries, _NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        query, score, doc = (np.concatenate([a, b]) for a, b in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        start = _grouped(query)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        keep = rank < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]
        full = rank == self.k - 1
        self.least[query[full]], self.last[query[full]] = score[full], doc[full]

    def open(self, query: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document of this id or a larger one, with this score at most, can still be among the best."""
        return (bound > self.least[query]) | ((bound == self.least[query]) & (doc <= self.last[query]) & (bound > 0))


def search_shard(tree: Tree, query: np.ndarray, hashes: np.ndarray, weight: np.ndarray, best: Best, width: int = WIDTH) -> None:
    """Adds to ``best`` what the shard has for the queries, given as rows by ascending query: term and its weight times its repeats."""
    if not len(tree.docs):
        return
    has, left, right = tree.lists(hashes)
    query, weight = query[has], weight[has]
    levels = len(tree.zeros)
    ids = tree.docs
    # A node: its query, level, first document and bound. Its ranges: node's place in these arrays, ends and weight, by ascending place.
    start = _grouped(query)
    node_q, node_level, node_doc = query[start], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    node_bound = np.add.reduceat(weight * tree.impacts[0][left], start) if len(start) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(query)))
    while len(node_q):
        leaf = node_level == levels
        if leaf.any():
            best.add(node_q[leaf], node_bound[leaf], ids[node_doc[leaf]])
        keep = ~leaf & best.open(node_q, node_bound, ids[node_doc])
        ranges = np.repeat(keep, size)
        node_q, node_level, node_doc, node_bound, size = node_q[keep], node_level[keep], node_doc[keep], node_bound[keep], size[keep]
        left, right, weight = left[ranges], right[ranges], weight[ranges]
        if not len(node_q):
            return
        order = np.lexsort((node_doc, -node_bound, node_q))
        begins = _grouped(node_q[order])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        taken = rank < width
        ranges = np.repeat(taken, size)
        of = np.repeat(np.arange(len(size)), size)[ranges]
        l, r, w = left[ranges], right[ranges], weight[ranges]  # noqa: E741
        parts = []
        for level in np.unique(node_level[taken]):
            here = node_level[of] == level
            lo, hi = tree.ones[level][l[here]].astype(np.int64), tree.ones[level][r[here]].astype(np.int64)
            step = 1 << (levels - 1 - int(level))
            for side, a, b in ((0, l[here] - lo, r[here] - hi), (1, tree.zeros[level] + lo, tree.zeros[level] + hi)):
                some = a < b
                parent, a, b, ww = of[here][some], a[some], b[some], w[here][some]
                begin = _grouped(parent)
                if not len(begin):
                    continue
                bound = np.add.reduceat(ww * tree.impacts[level + 1][a], begin)
                up = parent[begin]
                parts.append((node_q[up], np.full(len(up), level + 1), node_doc[up] + side * step, bound, np.diff(np.append(begin, len(parent))), a, b, ww))
        rest = np.repeat(~taken, size)
        parts.append((node_q[~taken], node_level[~taken], node_doc[~taken], node_bound[~taken], size[~taken], left[rest], right[rest], weight[rest]))
        node_q, node_level, node_doc, node_bound, size, left, right, weight = (np.concatenate([p[i] for p in parts]) for i in range(8))


def _search(query: np.ndarray, hashes: np.ndarray, weight: np.ndarray, queries: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k)
        for batch in batches:
            for row in range(len(batch)):
                search_shard(Tree({c: batch.column(c)[row].as_py() for c in batch.schema.names}), query, hashes, weight, best)
        doc = pa.array(best.doc, mask=best.doc == _NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), doc, pa.array(best.score)], ["query", "doc_id", "score"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, starts in zip(*(batch.column(c).to_pylist() for c in ("hashes", "starts")), strict=True):
            terms, df = np.frombuffer(hashes, np.int64), np.diff(np.frombuffer(starts, np.int32)).astype(np.int64)
            for at in range(0, len(df), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (terms, df)], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = _terms(part)
            row = np.repeat(np.arange(len(part)), np.diff(first))
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, np.int64)
            n = np.diff(np.append(start, len(row)))
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(row[start])), pa.array(hashes[start].view(np.int64)), pa.array(n)], ["item", "term", "repeats"])


def search(index: DataFrame, items: DataFrame, size: tuple[int, int], k: int = 10, item_id: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of ``index`` for the text of each row of ``items``, by falling score above 0.

    Equal scores go by ascending doc_id, a null one last. An item with a null text or without a term that some document has gets no row.
    Items that share an id are ranked each on its own; so are documents. The queries go to the tasks in blocks of about ``block_terms``
    terms, each block against all shards.
    """
    spark = index.sparkSession
    n, _ = size
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), "text"), "items")
    terms = written(rows.select("item", "text").mapInArrow(_query_terms, "item long, term long, repeats long"), "terms")
    asked = terms.select("term").distinct()
    df = index.select("hashes", "starts").mapInArrow(_frequencies, "term long, df long").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(terms.join(df, "term").select("item", "term", (weight * F.col("repeats")).alias("weight")).where("weight > 0"), "weighed")
    blocks = max(1, -(-weighed.count() // block_terms))
    weighed = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        mine = weighed.where(F.col("block") == block).orderBy("item").toArrow()
        names, query = np.unique(mine.column("item").to_numpy(), return_inverse=True)
        hits = index.mapInArrow(_search(query, mine.column("term").to_numpy().view(np.uint64), mine.column("weight").to_numpy(), len(names), k), "query long, doc_id long, score long")
        known = spark.createDataFrame(pa.table({"query": np.arange(len(names)), "item": names}))
        hits = hits.join(F.broadcast(known), "query").select("item", "doc_id", "score")  # a block's items
        hits = written(hits, f"hits{block}") if blocks > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    ranked = rows.select("item", "item_id").join(found, "item")
    return top(ranked, k).select("item_id", "rank", "doc_id", "score")


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each item: an item has k rows of each task at most, and of these each task passes on k."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Counts and indexes ``docs`` (``doc_id, text``), then searches them for each of ``items`` (``item_id, text``)."""
    size = corpus_size(docs)
    return search(written(build_index(docs, size), "index"), items, size, k)
