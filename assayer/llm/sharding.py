"""A uniform shuffle of documents into shards of exact size, by a hypergeometric communication matrix.

How many rows of each input block go to each shard is drawn first: row by row of the matrix, a multivariate hypergeometric
draw over what is left of the shards. Each block is then put in random order and cut at those counts, the pieces are
exchanged, and each shard is put in random order again. Every assignment of rows to shards with these sizes is thus equally
likely, and no shard's size is left to chance.

Only keys are exchanged: 40 bytes a row. Neither the blocks nor the shards need fit a task: a block has ``BLOCK_ROWS`` rows
at most, and a shard is ordered in buckets whose sizes are summed beforehand.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.scratch import written

#: Rows of a block and, about, of a bucket: what one task orders at a time.
BLOCK_ROWS = 1 << 18
BUCKET_ROWS = 1 << 16


def _hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are among the good ones: exact by urn for small n, by inversion from the mode else."""
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    total = good + bad
    if n <= 32:
        hit = 0
        for i in range(n):
            hit += rng.random() * (total - i) < good - hit
        return hit
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    # Weights relative to the mode, outwards until they no longer count; 12 standard deviations at most.
    weights, w, k = {mode: 1.0}, 1.0, mode
    while k < high and w > 1e-18:
        w *= (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))
        k += 1
        weights[k] = w
    w, k = 1.0, mode
    while k > low and w > 1e-18:
        w *= k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
        k -= 1
        weights[k] = w
    at = rng.random() * sum(weights.values())
    for k, w in weights.items():
        at -= w
        if at < 0:
            return k
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that go from each block to each shard; its sums are ``blocks`` and ``shards``, whose totals are equal."""
    rng, left = random.Random(seed), list(shards)
    matrix = []
    for n in blocks:
        row, rest = [], sum(left)
        for s in range(len(left)):
            rest -= left[s]
            took = _hypergeometric(rng, left[s], rest, n)
            n -= took
            row.append(took)
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _places(keys: DataFrame, shards: int, seed: int) -> DataFrame:
    """``keys`` (a stored table with a unique ``row``) with ``shard`` and ``slot``."""
    mixed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "row")
    keys = keys.withColumn("block", F.shiftright("row", 18))
    sizes = [(r["block"], r["n"]) for r in keys.groupBy("block").agg(F.count("*").alias("n")).orderBy("block").toLocalIterator()]
    rows = sum(n for _, n in sizes)
    matrix = communication_matrix([n for _, n in sizes], [(rows + shards - 1 - s) // shards for s in range(shards)], seed)
    cuts = [(block, [sum(row[: s + 1]) for s in range(shards)]) for (block, _), row in zip(sizes, matrix, strict=True)]
    # A row for each block of up to BLOCK_ROWS rows; as a relation, so that Spark sizes the join.
    bounds = keys.sparkSession.createDataFrame(cuts, "block long, ends array<long>")
    local = Window.partitionBy("block").orderBy(mixed("within"), "row")
    dealt = keys.withColumn("rank", F.row_number().over(local)).join(bounds, "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    buckets = 1 + rows // (shards * BUCKET_ROWS)
    dealt = written(dealt.drop("block", "rank", "ends").withColumn("bucket", F.pmod(mixed("bucket"), F.lit(buckets))), "dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    again = Window.partitionBy("shard", "bucket").orderBy(mixed("again"), "row")
    placed = dealt.withColumn("slot", F.row_number().over(again).cast("long") - 1).join(offsets, ["shard", "bucket"])
    return placed.withColumn("slot", F.col("slot") + F.col("before")).drop("bucket", "before")


def shuffle_into_shards(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text", seed: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``id, size, text_crc32, law, shard, slot, grown_shard``.

    Shards are 0 to ``shards`` - 1; their row counts differ by one at most (law ``rows``). ``slot`` runs from 0 in each shard
    without gaps. ``size`` is the UTF-8 bytes of the text plus 1, a null text having none; its checksum is that of an empty
    one. Null and repeated ids are rows like any other, equal texts too. Without rows the result is empty. ``grown_shard`` is
    null: another shard deals all rows anew. Other columns of ``docs`` are not read.
    """
    keys = docs.select(
        F.col(id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Numbered once and written: a task that runs again elsewhere must not number its rows anew.
    placed = _places(written(keys, "keys"), shards, seed)
    return placed.select(F.col("id").alias(id), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 10) -> None:
    """Write ``docs`` as Parquet, a folder for each shard, each file holding consecutive slots in order."""
    stored = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs")
    placed = _places(stored.select("row"), shards, seed)
    parts = shards * (1 + stored.count() // (shards * BUCKET_ROWS))
    rows = stored.join(placed, "row").repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(F.col("shard").alias("_shard"), "doc.*").write.partitionBy("_shard").parquet(path)
