"""Sequences of at most ``window`` tokens, each filled with lexically near documents by BM25 retrieval.

Every task reads its part of the corpus in shards of about ``SHARD_TOKENS`` tokens and builds an inverted index of each. The
first unused document seeds a sequence; the index returns its nearest unused neighbours by BM25, which fill the window one
after another. The last of them is cut where the window ends, and what is left of it seeds the next sequence. A document
longer than the window first fills whole sequences of its own. What a shard leaves over opens the next shard, so a task pads
one sequence at most, its last. Tokens are never exchanged, and memory holds one shard.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.words import slices

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 20
#: The constants of BM25, and the share of pieces from which a term's weights are kept as a row of all pieces.
K1, B, DENSE = 1.2, 0.75, 0.05
#: From this many white-space characters on end, `tiktoken`'s regular expression may run out of stack (800,000 pass).
SPACE_RUN = 10_000
_ranked: dict = {}
_spaces = re.compile(rf"(?<!\s)\s{{{SPACE_RUN}}}")

#: How byte-level BPE cuts a text before merging.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_rank(path: str):
    """The same encoding by rank, if the file is a byte-level BPE whose ids follow its merges; else none."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, merges = model["model"].get("vocab"), model["model"].get("merges")
    pre = model.get("pre_tokenizer") or {}
    if model["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer") or not merges:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    import tiktoken

    # Bytes that print stand for themselves, the others for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("by_rank", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Token ids as the tokenizer at ``path`` gives them for whole texts, by the faster of two libraries that can."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if path not in _ranked:
            _ranked[path] = _by_rank(path)
        self.by_rank = _ranked[path]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in (t or "" for t in texts):
            if self.by_rank and not any(s in text for s in self.special) and not (len(text) >= SPACE_RUN and _spaces.search(text)):
                ids = self.by_rank(text)
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out.append(np.array([*ids, END], dtype=np.uint32))
        return out


class Piece:
    """A part of a document that no sequence holds yet: its ids from ``start`` on."""

    __slots__ = ("id", "ids", "start")

    def __init__(self, id: int | None, ids: np.ndarray, start: int = 0):
        self.id, self.ids, self.start = id, ids, start

    def __len__(self) -> int:
        return len(self.ids) - self.start


class Index:
    """The inverted index of a shard: for each term its pieces and their BM25 weights."""

    def __init__(self, pieces: list[Piece]):
        lengths = np.array([len(p) for p in pieces])
        term = np.concatenate([p.ids[p.start :] for p in pieces]).astype(np.int64)
        key, tf = np.unique(term * len(pieces) + np.repeat(np.arange(len(pieces)), lengths), return_counts=True)
        self.piece = key % len(pieces)
        self.terms, self.first, df = np.unique(key // len(pieces), return_index=True, return_counts=True)
        self.first = np.append(self.first, len(key))
        self.idf = np.log(1 + (len(pieces) - df + 0.5) / (df + 0.5))
        self.df = df
        norm = K1 * (1 - B + B * lengths[self.piece] / lengths.mean())
        self.weight = (np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        # The commonest terms have few empty places: rows of their own, which are summed faster than lists.
        often = np.flatnonzero(df > max(1, DENSE * len(pieces)))
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(pieces)), np.float32)
        for i, t in enumerate(often):
            self.rows[i, self.piece[self.first[t] : self.first[t + 1]]] = self.weight[self.first[t] : self.first[t + 1]]

    def scores(self, ids: np.ndarray, n: int) -> np.ndarray:
        """BM25 of each piece for all distinct terms of ``ids``."""
        at = np.searchsorted(self.terms, np.unique(ids))
        row, at = self.row[at], at[(self.row[at] < 0) & (self.df[at] > 1)]
        count = self.first[at + 1] - self.first[at]
        rows = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.piece[rows], self.weight[rows], n) + self.rows[row[row >= 0]].sum(axis=0)


def fill(pieces: list[Piece], window: int) -> tuple[list[list[tuple[Piece, int]]], list[Piece]]:
    """Full sequences, each a list of pieces and how many ids it takes of them, and what is left over."""
    done: list[list[tuple[Piece, int]]] = []
    for p in pieces:
        while len(p) >= window:
            done.append([(Piece(p.id, p.ids, p.start), window)])
            p.start += window
    pieces = [p for p in pieces if len(p)]
    if not pieces:
        return done, []
    index, unused = Index(pieces), np.ones(len(pieces), dtype=bool)
    at, seed = 0, None
    while True:
        while seed is None and at < len(pieces):
            seed = at if unused[at] else None
            at += 1
        if seed is None:
            return done, []
        unused[seed] = False
        sequence, room, cut = [(pieces[seed], len(pieces[seed]))], window - len(pieces[seed]), None
        if room:
            scores = np.where(unused, index.scores(pieces[seed].ids[pieces[seed].start :], len(pieces)), -1.0)
            for near in np.argsort(-scores, kind="stable"):
                if not room or scores[near] < 0:
                    break
                took = min(room, len(pieces[near]))
                sequence.append((pieces[near], took))
                room -= took
                cut = int(near) if took < len(pieces[near]) else None
                unused[near] = False
        if room:
            return done, [p for p, _ in sequence]
        done.append([(Piece(p.id, p.ids, p.start), n) for p, n in sequence])
        if cut is not None:
            pieces[cut].start += sequence[-1][1]
            unused[cut] = True
        seed = cut


_COLUMNS = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, window: int, with_ids: bool):
    def rows(sequences: list[list[tuple[Piece, int]]], number: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for k, sequence in enumerate(sequences):
            offset = 0
            for p, n in sequence:
                ids = p.ids[p.start : p.start + n]
                for column, x in zip(out, (p.id, p.start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(p.ids), number + k, offset, ids.astype(np.int32) if with_ids else None), strict=True):
                    column.append(x)
                offset += n
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.list_(pa.int32())) for i, c in enumerate(out[: 7 + with_ids])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = Encoder(path), TaskContext.get().partitionId() << 33
        held: list[Piece] = []
        tokens = 0
        for batch in batches:
            for part in slices(batch, "text"):
                new = encode(part.column("text").to_pylist())
                held += [Piece(i, x) for i, x in zip(part.column("id").to_pylist(), new, strict=True)]
                tokens += sum(map(len, new))
                if tokens >= SHARD_TOKENS:
                    done, held = fill(held, window)
                    yield rows(done, number)
                    number, tokens = number + len(done), 0
        done, held = fill(held, window)
        yield rows(done + [[(p, len(p)) for p in held]] * bool(held), number)

    return run


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked.

    A document's ids are those that the tokenizer file ``tokenizer`` gives for its whole text (null: empty), then ``END``; each
    lies in exactly one piece. Sequences hold ``window`` ids, the last of a task perhaps fewer. Null and repeated ids are
    documents like any other. Without rows the result is empty. Other columns of ``docs`` are not read.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(_pack(tokenizer, window, with_ids), _COLUMNS + ", ids array<int>" * with_ids).withColumnRenamed("id", id)
