"""Nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals, and exact reranking.

Vectors are scaled to length 1. A bounded sample fits the centroids and the codebooks; every vector is then filed under its
nearest centroid, and its residual becomes one byte for each sub-space; how far the code is from the vector is kept with it. A
query looks into the lists of its ``probes`` nearest centroids and scores their codes by asymmetric distance tables. A vector is
no farther from its code's place than that error, so every candidate that can still be among the ``k`` nearest of its block is
scored on the vector itself, however many they are, and the block's ``k`` nearest go on. Vectors of length 1 are as near by distance as by cosine; the tables hold distances,
as what a code leaves out then counts only in proportion to the distance, and near copies are still told apart.

A list is stored in blocks of ``BLOCK`` vectors and meets the queries in chunks of ``CHUNK``, so a list with a third of all
vectors is many joined rows, not one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.scratch import written

#: Vectors that fit the quantiser, at most: those whose hash is smallest.
SAMPLE = 20_000
SUBSPACES, CODES = 32, 256
#: A list to so many vectors of the sample, at least; besides, there are as many lists as the square root of all vectors.
LISTED = 8
#: Queries of the sample that the number of lists to look into is tuned on, and the share of their neighbours to be found.
TUNED, RECALL = 500, 0.97
#: What single precision adds to a distance's error, at most.
SLACK = 2e-3
BLOCK, CHUNK = 16_384, 256


@dataclass
class Quantiser:
    centroids: np.ndarray
    #: Dimensions of each sub-space, and its codewords.
    cuts: list[np.ndarray]
    books: list[np.ndarray]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Each row's n nearest centroids, nearest first."""
        d = (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's list, its code, and how far the code's place is from it."""
        lists = self.nearest(x, 1)[:, 0]
        r = x - self.centroids[lists]
        codes = [((b**2).sum(axis=1) - 2 * r[:, c] @ b.T).argmin(axis=1) for c, b in zip(self.cuts, self.books, strict=True)]
        error = sum(((r[:, c] - b[at]) ** 2).sum(axis=1) for c, b, at in zip(self.cuts, self.books, codes, strict=True))
        return lists, np.stack(codes, axis=1).astype(np.uint8), np.sqrt(error)

    def scores(self, query: np.ndarray, one: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances, negated, of queries from the coded vectors of a list, from tables of the queries' own residuals."""
        r = query - self.centroids[one]
        out = np.zeros((len(query), len(codes)), dtype=np.float32)
        for s, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = 2 * r[:, c] @ b.T - (b**2).sum(axis=1) - (r[:, c] ** 2).sum(axis=1)[:, None]
            out += table[:, codes[:, s]]
        return out


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        mine = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(mine, minlength=k)
        sums = np.stack([np.bincount(mine, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(x.dtype)
        centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def fit(x: np.ndarray, total: int, seed: int = 1) -> Quantiser:
    """The quantiser of ``total`` vectors, of which ``x`` is a sample."""
    rng = np.random.default_rng(seed)
    centroids = _means(x, max(1, min(round(total**0.5), len(x) // LISTED)), 12, rng)
    r = x - centroids[((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)]
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(c)]
    return Quantiser(centroids, cuts, [_means(r[:, c], CODES, 8, rng) for c in cuts])


def probes_for(q: Quantiser, x: np.ndarray, k: int) -> int:
    """How many lists the sample's own queries must look into to find ``RECALL`` of their k nearest in the sample.

    Neighbours in all vectors are nearer than those in a sample, and so lie in nearer lists: the number errs on the safe side.
    """
    asked = x[:TUNED]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    found = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(asked), 1), int)
    rank = np.argsort(q.nearest(asked, len(q.centroids)), axis=1)
    lists = q.nearest(x, 1)[:, 0]
    needed = np.sort(np.take_along_axis(rank, lists[found], axis=1).ravel())
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(kind)


def _file(quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), np.float64)
            lists, codes, error = quantiser.value.encode(x.astype(np.float32))
            parts = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column("id"), batch.column("row"), *parts], ["list", "id", "row", "code", "error", "unit"])

    return run


def _probe(quantiser, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), np.float64)
            near = quantiser.value.nearest(x.astype(np.float32), probes)
            at = np.repeat(np.arange(len(x)), near.shape[1])
            unit = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column("id").take(pa.array(at)), unit.take(pa.array(at))], ["list", "query", "unit"])

    return run


def _search(quantiser, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                entries, asked = row.column("entries").flatten(), row.column("asked").flatten()
                ids, query = entries.field("id").to_numpy(), asked.field("query").to_numpy()
                codes, units, wanted = (np.frombuffer(b"".join(x.to_pylist()), kind).reshape(len(x), -1) for x, kind in ((entries.field("code"), np.uint8), (entries.field("unit"), np.float64), (asked.field("unit"), np.float64)))
                order = np.argsort(ids, kind="stable")
                ids, codes, units, error = ids[order], codes[order], units[order], entries.field("error").to_numpy()[order] + np.float32(SLACK)
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                out: list[list[np.ndarray]] = [[], [], []]
                for a in range(0, len(query), 32):
                    far = np.sqrt(np.maximum(-q.scores(wanted[a : a + 32].astype(np.float32), row.column("list")[0].as_py(), codes), 0))
                    far[query[a : a + 32, None] == ids[None, :]] = np.inf
                    # Rows that repeat an id count once: the k-th nearest id is no farther than this.
                    most = np.minimum.reduceat(far + error, first, axis=1)
                    bound = np.partition(most, k - 1, axis=1)[:, k - 1] if len(first) > k else np.full(len(most), np.inf)
                    for one, unit, low, limit in zip(query[a : a + 32], wanted[a : a + 32], far - error, bound, strict=True):
                        at = np.flatnonzero((low <= limit) & np.isfinite(low))
                        # Equal vectors get equal scores only up to rounding.
                        score = np.round(np.einsum("ij,j->i", units[at], unit), 13)
                        best = np.lexsort((ids[at], -score))
                        _, kept = np.unique(ids[at][best], return_index=True)
                        best = best[np.sort(kept)[:k]]
                        for column, x in zip(out, (np.full(len(best), one), ids[at][best], score[best]), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query", "id", "near"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """The ``k`` nearest found of ``vectors`` for each row of ``queries``: ``query_id, rank`` from 1, ``id, score``.

    ``score`` is the cosine in double precision of the vectors as given; ties go to the smaller id. A query's own id is no
    candidate. Vectors that are null, zero or hold a null or non-finite component, and rows without an id, take no part; nor
    do those of another length than the commonest (the longer, if two are). Rows that repeat an id count once, by their best score.
    Without queries or candidates the result is empty. Other columns are not read. ``probes`` is how many lists a query looks
    into, by default as many as the sample's queries need.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return df.where(F.col(id).isNotNull() & v.isNotNull() & finite).select(F.col(id).cast("long").alias("id"), v.alias("vector"), length.alias("length")).where("length > 0")

    rows, asked = sound(vectors), sound(queries)
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id} long, score double")
    rows, asked = (x.where(F.size("vector") == common["d"]) for x in (rows, asked))
    sample = rows.select("vector").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE).toArrow().column("vector").combine_chunks()
    sample = _matrix(sample)
    fitted = fit(sample, common["count"])
    probes = probes or probes_for(fitted, sample, k)
    quantiser = spark.sparkContext.broadcast(fitted)

    filed = rows.select("id", F.monotonically_increasing_id().alias("row"), "vector").mapInArrow(_file(quantiser), "list int, id long, row long, code binary, error float, unit binary")
    filed = written(filed, "filed")
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = filed.join(sizes, "list").groupBy("list", F.pmod(F.xxhash64("row"), "blocks").alias("block")).agg(F.collect_list(F.struct("id", "code", "error", "unit")).alias("entries"))
    probing = asked.select("id", "vector").mapInArrow(_probe(quantiser, probes), "list int, query long, unit binary")
    chunks = probing.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = probing.join(chunks, "list").groupBy("list", F.pmod(F.xxhash64("query"), "chunks").alias("chunk")).agg(F.collect_list(F.struct("query", "unit")).alias("asked"))
    found = chunked.join(blocks, "list").select("list", "asked", "entries").mapInArrow(_search(quantiser, k), "query long, id long, near double")

    first = Window.partitionBy("query").orderBy(F.desc("near"), "id")
    found = found.groupBy("query", "id").agg(F.max("near").alias("near")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
    found = written(found.select("query", "id"), "found")
    whole = rows.select("id", F.col("vector").alias("v"), F.col("length").alias("nv"))
    from_ = asked.select(F.col("id").alias("query"), F.col("vector").alias("q"), F.col("length").alias("nq"))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = found.join(whole, "id").join(from_, "query").select("query", "id", (dot / (F.col("nq") * F.col("nv"))).alias("score"))
    scored = scored.groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id), "score")
