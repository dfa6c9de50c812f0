"""Near-duplicate documents by SetSketch registers: banding, a joint likelihood estimate, then exact verification.

A register holds the exponentially spaced, truncated minimum of one hash over a document's shingles. Two documents share a
register about as often as their Jaccard similarity, so bands of ``ROWS`` registers find pairs of ``percent`` % or more:
at 80 % one of 42 bands of 6 agrees in all but 3 of a million pairs. Registers also merge (the larger of two), so parts of
one text may be sketched apart.

Work that grows with the square of a group is avoided in three ways. Equal shingle sets become one class first. In a bucket
each class is tried against one centre, the class that shares most buckets with others, so a group of n near copies costs n
pairs a band, not n * n. Where a bucket still holds several components, the pairs across them are tried, so that no link that
the bands see is lost; but a pair is made only if what its classes share with their centre, and what they may share beside it
by a map of 256 bits, can reach the threshold. A class that isn't linked with its centre shares too little with it, so the
pairs that are left are those that have words in common which the centre lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.scratch import written
from assayer.llm.words import SPACED, mixed, run_hashes, slices, words

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Parameters of the sketch: base of the spacing, rate of the exponential values, and the largest register.
BASE, RATE, LARGEST = 1.001, 20.0, 65534
#: Pairs whose estimate lies this far below the threshold aren't verified; it is over six standard deviations.
SLACK = 0.17

_rng = np.random.Generator(np.random.PCG64(9))
_MUL = (_rng.integers(0, 2**32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct k-word shingles; of fewer words, their whole sequence is one."""
    w = words(column, SPACED, lower=True)
    count = np.diff(w.first)
    length = np.where(count >= k, k, count)
    n = np.where(count > 0, count - length + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], n)
    hashes = run_hashes(mixed(w.hash), at, at + np.repeat(length, n))
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def total(shingles: np.ndarray) -> int:
    return int(shingles.sum(dtype=np.uint64).view(np.int64))


def registers(shingles: np.ndarray) -> np.ndarray:
    """A set's SetSketch: register i is floor(1 - log_b x) of the least value x that its hash i gives, cut to 0..LARGEST."""
    x = mixed(shingles).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[None, at : at + 512] * _MUL + _ADD).min(axis=1), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def joint_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair, from how many registers are larger, smaller and equal."""
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    equal = ra.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        over, under = np.clip(p(np.maximum(u - v * j, 0)), 1e-12, 1), np.clip(p(np.maximum(v - u * j, 0)), 1e-12, 1)
        return up * np.log(over) + down * np.log(under) + equal * np.log(np.clip(1 - over - under, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(a) < likelihood(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                spread = [mixed(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets]).astype(np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(mixed(s), initial=np.uint64(0)) for s in spread]).astype(np.uint64).view(np.int64)),
                        pa.array([registers(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    ["id", "n", "h1", "h2", "registers"],
                )

    return run


def _keys(r: np.ndarray) -> np.ndarray:
    r = r.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mixed(mixed((r + np.uint64(1)) * _BAND).sum(axis=2, dtype=np.uint64) + _BAND[:, 0]).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            keys = _keys(np.frombuffer(b"".join(part.column("registers").to_pylist()), dtype=np.uint16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), BANDS))], ["bucket", "rep"]
            )


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's buckets, and a bit of each register: where two sketches agree, so do the bits, and in half of the rest."""
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            r = np.frombuffer(b"".join(part.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            bits = np.zeros((len(r), -(-REGISTERS // 64) * 64), dtype=np.uint8)
            bits[:, :REGISTERS] = mixed(r.astype(np.uint64) + _BAND.ravel()) & np.uint64(1)
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), part.column("n"), pa.array([*_keys(r)], pa.list_(pa.int64())), pa.array([*packed], pa.list_(pa.int64()))], ["rep", "n", "buckets", "bits"]
            )


#: Longs of the map of what a class has and its centre lacks.
BESIDE = 4


def _beside(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(BESIDE * 64, dtype=np.uint8)
    bits[(mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _likely(percent: int):
    """Pairs that the joint estimate leaves possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                yield part.select(["a", "b"]).filter(pa.array(joint_estimate(ra, rb, na, nb) >= percent / 100 - SLACK))

    return run


_TRIED = "a long, b long, linked boolean, beside long, map array<long>"


def _verify(k: int, percent: int):
    """For each pair of a centre and a class: if they are linked, and what the class has beside the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[tuple, np.ndarray] | None = None  # the last centre's shingles; its pairs follow one another
        for batch in batches:
            for part in slices(batch, "text_b"):
                mine = shingle_sets(part.column("text_b"), k)
                ha, hb = (part.column(c).to_numpy() for c in ("h1_a", "h1_b"))
                out: list[tuple] = []
                for row, s in enumerate(mine):
                    centre = part.column("a")[row].as_py()
                    if known is None or known[0] != (centre, ha[row]):
                        known = (centre, ha[row]), shingle_sets(part.column("text_a").slice(row, 1), k)[0]
                    if total(s) != hb[row] or total(known[1]) != ha[row]:
                        continue  # another text of an id that has several
                    other = np.setdiff1d(s, known[1], assume_unique=True)
                    both = len(s) - len(other)
                    linked = 100 * both >= percent * (len(s) + len(known[1]) - both)
                    out.append((centre, part.column("b")[row].as_py(), linked, len(other), _beside(other)))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "linked", "beside", "map"])

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, kept``.

    Documents whose sets of distinct ``shingle``-word shingles have a Jaccard similarity of ``percent`` % or more are linked;
    ``component_id`` is the smallest id that links reach, and ``kept`` says that it is the document's own. A null or empty text,
    or one without words, has no shingles and is linked with nothing. A null id is in no component (null) and kept. Rows that
    repeat an id get one component, that of all its texts. Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = written(docs.mapInArrow(_sketches(shingle), "id long, n long, h1 long, h2 long, registers binary"), "sketches")
    some = sketches.where("n > 0 and id is not null")
    # Equal sets have equal sketches, so any one of them stands for the class.
    classes = written(some.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("registers").alias("registers")), "classes")

    bands = written(classes.mapInArrow(_bands, "bucket long, rep long"), "bands")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(bands.join(sizes, "bucket"), "shared")
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    centres = shared.join(weights, "rep").groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("rep"), "rep"))["rep"].alias("centre"))
    shared = written(shared.join(centres, "bucket").select("bucket", "rep", "centre"), "centred")
    wanted = shared.select("rep").distinct()
    texts = written(classes.join(wanted, "rep", "left_semi").join(docs.withColumnRenamed("id", "rep"), "rep").select("rep", "h1", "text").dropDuplicates(["rep", "h1", "text"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        def side(s: str) -> DataFrame:
            return texts.select(F.col("rep").alias(s), F.col("h1").alias(f"h1_{s}"), F.col("text").alias(f"text_{s}"))

        return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verify(shingle, percent), _TRIED)

    stars = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tried = written(verified(stars), "tried")
    links = tried.where("linked").select("a", "b")
    reached = components(links).checkpoint()

    # Buckets whose members the stars left in several components: pairs across components that can be linked.
    open_ = shared.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed_ = open_.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    rest = open_.where("rep <> centre").join(mixed_, "bucket").select("bucket", "rep", "component", "centre")
    marks = classes.join(rest.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "registers").mapInArrow(_marks, "rep long, n long, buckets array<long>, bits array<long>")
    rest = rest.join(marks, "rep").join(tried.select(F.col("a").alias("centre"), F.col("b").alias("rep"), "beside", "map"), ["centre", "rep"])
    rest = written(rest, "rest")
    left, right = (rest.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "buckets", "bits", "beside", "map"))) for s in ("a", "b"))
    # Registers that differ at the threshold, half of which show in the bits, and six standard deviations more.
    unlike = (1 - percent / 100) / 2
    limit = int(REGISTERS * unlike + 6 * (REGISTERS * unlike * (1 - unlike)) ** 0.5) + 1
    ones = lambda x, y, f: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(f(p, q))), F.lit(0), lambda a, p: a + p)
    differ = ones("bits_a", "bits_b", Column.bitwiseXOR)
    lacks = lambda p, q: p.bitwiseAND(F.bitwise_not(q))
    # Shingles of both: at most those of the centre, and those beside it that the other's map doesn't lack.
    common = F.least(F.col("n_a") - F.col("beside_a"), F.col("n_b") - F.col("beside_b")) + F.least(
        F.col("beside_a") - ones("map_a", "map_b", lacks), F.col("beside_b") - ones("map_b", "map_a", lacks)
    )
    pairs = left.join(right, "bucket").where(
        (F.col("rep_a") < F.col("rep_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        & (F.lit(100 + percent) * common >= F.lit(percent) * (F.col("n_a") + F.col("n_b")))
        & (differ <= limit)
        # What shuts a pair out of one bucket shuts it out of all, and with a bucket's centre it was tried: the first bucket is enough.
        & (F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket"))
    )
    pairs = written(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), "pairs")
    # Sketches travel before texts do.
    sketch = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"registers_{s}"))
    likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b").mapInArrow(_likely(percent), "a long, b long")
    more = written(verified(likely).where("linked").select("a", "b"), "more")
    if not more.isEmpty():
        reached = components(links.unionByName(more))

    groups = classes.select("h1", "h2", "n", "rep").join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    return (
        sketches.select("id", "n", "h1", "h2")
        .join(groups, ["h1", "h2", "n"], "left")
        .select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
    )
