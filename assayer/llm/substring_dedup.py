"""Repeated passages by relative Lempel-Ziv parsing of every document against indexed reference blocks.

The reference of a document is every document with a smaller id. Its windows of ``window`` words are dealt by hash into
blocks; a block's index holds, for each window, the smallest document in which it starts. A document is looked up in every
block that one of its windows falls into. What is indexed is thus windows, not the reference's text: a factor begins at the
first word whose window starts in a smaller document and goes on while the next windows have that same smallest document, and
a window that straddles the end of a factor begins the next. That the reference holds a factor as one run is not looked up. The
words in factors are exactly those that some window covers which starts in a smaller document, which is what is removed.

Only window hashes are exchanged, 7 bytes each, packed by document and block; the block adds the bits of another hash. The
number of blocks grows with the corpus, so that a block's index fits a task: at 10**12 windows one window in 10**5 million is
taken for another.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.words import SPACED, Words, mixed, slices, windows, words

WINDOW = 13
#: Bytes of text whose windows make one block: about 3 million windows, 200 MB while it is indexed.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are dealt out together: the larger, the fewer rows a block gets.
DEALT_BYTES = 4 << 20
#: No source: the largest long, which is smaller than no id.
NONE = 2**63 - 1


def _blocks_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: row i is the bytes of ``data[ends[i - 1]:ends[i]]``."""
    offsets = np.concatenate([[0], ends]) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)


def _deal(window: int, blocks: int):
    """A row for each block and slice of the input: its documents, how many windows each has there, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", DEALT_BYTES):
                w = words(part.column("text"), SPACED)
                _, hashes, first = windows(w, window)
                block = _blocks_of(hashes, blocks)
                order = np.argsort(block * len(w) + np.repeat(np.arange(len(w)), np.diff(first)), kind="stable")
                doc, block, hashes = np.repeat(np.arange(len(w)), np.diff(first))[order], block[order], hashes[order]
                at = _starts(block * len(w) + doc)  # a document's windows in a block
                rows = _starts(block[at])
                ends = np.append(rows[1:], len(at))[: len(rows)]
                ids, prints = part.column("id").to_numpy(), part.column("print").to_numpy()
                counts = np.diff(np.append(at, len(doc))).astype(np.int32)
                short = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :7]).view("V7").ravel() if len(hashes) else np.zeros(0, "V7")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[at[rows]], pa.int32()),
                        _binary(ids[doc[at]].astype(np.int64), ends),
                        _binary(prints[doc[at]].astype(np.int32), ends),
                        _binary(counts, ends),
                        _binary(short, np.append(at, len(doc))[ends]),
                    ],
                    ["block", "ids", "prints", "counts", "hashes"],
                )

    return run


def _index(blocks: int):
    """For each document of a block: which of its windows, by rank, start in a smaller document, and in which one first.

    A row holds all such documents of one home, which is where the parts of a document meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes, bytes, bytes]]] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                held[row["block"]].append((row["ids"], row["prints"], row["counts"], row["hashes"]))
        while held:
            block, rows = held.popitem()
            ids, prints, counts = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in enumerate((np.int64, np.int32, np.int32)))
            short = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, 7)
            del rows
            full = np.zeros((len(short), 8), np.uint8)
            full[:, :7] = short
            hashes = full.view(np.uint64).ravel()
            del short, full
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
            order = np.argsort(hashes)
            groups = _starts(hashes[order])
            least = np.minimum.reduceat(ids[doc[order]], groups)
            source = np.empty(len(order), np.int64)
            source[order] = np.repeat(least, np.diff(np.append(groups, len(order))))
            hit = np.flatnonzero(source < ids[doc])
            home = _blocks_of(ids.view(np.uint64) ^ (prints.astype(np.uint64) << np.uint64(32)), blocks)
            hit = hit[np.argsort(home[doc[hit]], kind="stable")]
            rank = (hit - (np.cumsum(counts) - counts)[doc[hit]]).astype(np.int32)
            at = _starts(doc[hit])
            mine = doc[hit[at]]
            rows_at = _starts(home[mine])
            ends = np.append(rows_at, len(at))[1:]
            hits_end = np.append(at, len(hit))[ends]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(home[mine[rows_at]].astype(np.int32)),
                    pa.array(np.full(len(rows_at), block, np.int32)),
                    _binary(ids[mine], ends),
                    _binary(prints[mine], ends),
                    _binary(np.diff(np.append(at, len(hit))).astype(np.int32), ends),
                    _binary(rank, hits_end),
                    _binary(source[hit], hits_end),
                ],
                ["home", "block", "ids", "prints", "counts", "ranks", "sources"],
            )

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a home: its blocks one after another, the hits in each, their ranks and sources."""
    parts: dict[str, list] = {c: [] for c in ("ids", "prints", "counts", "ranks", "sources", "blocks")}
    for batch in batches:
        for row in batch.to_pylist():
            for c in ("ids", "prints", "counts", "ranks", "sources"):
                parts[c].append(row[c])
            parts["blocks"].append(np.full(len(row["counts"]) // 4, row["block"], np.int32).tobytes())
    ids, prints, counts, ranks, sources, blocks = (np.frombuffer(b"".join(parts.pop(c)), t) for c, t in (("ids", np.int64), ("prints", np.int32), ("counts", np.int32), ("ranks", np.int32), ("sources", np.int64), ("blocks", np.int32)))
    if not len(ids):
        return
    order = np.lexsort((blocks, prints, ids))
    # A document that comes more than once has the same hits each time.
    once = np.ones(len(order), dtype=bool)
    once[1:] = (ids[order[1:]] != ids[order[:-1]]) | (prints[order[1:]] != prints[order[:-1]]) | (blocks[order[1:]] != blocks[order[:-1]])
    order = order[once]
    begin = np.cumsum(counts) - counts
    doc_at = np.flatnonzero(np.append(True, (np.diff(ids[order]) != 0) | (np.diff(prints[order]) != 0)))
    for a in range(0, len(doc_at), 2000):
        rows = np.append(doc_at, len(order))[a : a + 2001]
        mine = order[rows[0] : rows[-1]]
        n = counts[mine]
        hits = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ends = rows[1:] - rows[0]
        hit_ends = np.cumsum(n)[ends - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[mine[rows[:-1] - rows[0]]]), pa.array(prints[mine[rows[:-1] - rows[0]]]), _binary(blocks[mine], ends), _binary(n, ends), _binary(ranks[hits], hit_ends), _binary(sources[hits], hit_ends)],
            ["id", "print", "blocks", "counts", "ranks", "sources"],
        )


def factors(source: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """The greedy parse of one document: (first word, words, reference document) of each factor, in order.

    ``source[i]`` is the smallest document in which the window at word i starts, ``NONE`` for none.
    """
    hit = np.flatnonzero(source != NONE)
    if not len(hit):
        return []
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(source[hit]) != 0)) + 1
    return [(int(run[0]), int(run[-1] - run[0]) + window, int(source[run[0]])) for run in np.split(hit, cut)]


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """For each text its words that are kept, joined by one space."""
    at = np.flatnonzero(keep)
    doc = np.searchsorted(w.first, at, side="right") - 1
    last = np.append(doc[1:] != doc[:-1], True)[: len(at)]
    data = np.append(w.data, np.uint8(32))
    data[w.end[at[~last]]] = 32
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[w.start[at]] += 1
    edge[w.end[at] + ~last] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    sizes = np.concatenate([[0], np.cumsum(inside)])[w.offsets]
    return pa.Array.from_buffers(pa.large_string(), len(w), [None, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())]).cast(pa.string())


_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())]))


def _parse(window: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), SPACED)
                keep = np.ones(len(w.start), dtype=bool)
                _, hashes, first = windows(w, window)
                spans: list[list[dict]] = []
                for d, (at, counts, ranks, sources) in enumerate(zip(*(part.column(c).to_pylist() for c in ("blocks", "counts", "ranks", "sources")), strict=True)):
                    spans.append([])
                    if at is None:
                        continue
                    block = _blocks_of(hashes[first[d] : first[d + 1]], blocks)
                    order = np.argsort(block, kind="stable")
                    begin = np.searchsorted(block[order], np.frombuffer(at, np.int32))
                    source = np.full(len(block), NONE, dtype=np.int64)
                    source[order[np.repeat(begin, np.frombuffer(counts, np.int32)) + np.frombuffer(ranks, np.int32)]] = np.frombuffer(sources, np.int64)
                    for a, n, s in factors(source, window):
                        keep[w.first[d] + a : w.first[d] + a + n] = False
                        spans[-1].append({"start": a, "length": n, "source": s})
                n_words = np.diff(w.first)
                left = np.concatenate([[0], np.cumsum(keep)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n_words.astype(np.int64)), pa.array((n_words - np.diff(left[w.first])).astype(np.int64)), joined(w, keep), pa.array(spans, _FACTORS)],
                    ["id", "n_words", "n_removed", "kept", "factors"],
                )

    return run


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_removed, kept, factors``.

    ``kept`` is the words that no factor covers, joined by one space; ``factors`` lists start, length and reference document of
    each. Windows are judged on the input. A null text has no words, and a text of fewer words than ``window`` no windows. A
    document with a null id is left as it is and is no reference. Rows that repeat an id don't make each other repeats.
    Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.hash(text).alias("print"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    dealt = docs.where("id is not null").mapInArrow(_deal(window, blocks), "block int, ids binary, prints binary, counts binary, hashes binary")
    found = dealt.repartitionById(blocks, "block").mapInArrow(_index(blocks), "home int, block int, ids binary, prints binary, counts binary, ranks binary, sources binary")
    found = found.repartitionById(blocks, "home").mapInArrow(_gather, "id long, print int, blocks binary, counts binary, ranks binary, sources binary")
    parsed = docs.join(found, ["id", "print"], "left").select("id", "text", "blocks", "counts", "ranks", "sources")
    return parsed.mapInArrow(_parse(window, blocks), "id long, n_words long, n_removed long, kept string, factors array<struct<start: long, length: long, source: long>>").withColumnRenamed("id", id)
