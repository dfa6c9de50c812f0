"""The trie of conversations' shared beginnings, by prefix doubling.

Turns are named by integers, equal turns alike. In round k two neighbouring blocks of 2**k turns make one of twice the length,
named by the pair of their names; only blocks that begin at a multiple of their length are needed, so the rounds' rows add up to
twice the turns. A prefix of d turns is then composed of the blocks in d's binary expansion, the largest first: every prefix
whose lowest power of two is 2**k comes from a shorter one and one block, which takes another row of rounds from the largest
block down. Rounds are logarithmic in the longest conversation.

A block's name is the smallest turn number of the blocks equal to it, turns being numbered through; a prefix's name is the
smallest conversation that has it. Names thus need no state, and come out the same when a lost task runs again. A name is a
grouped minimum, joined back to its rows; a group with most of the rows is pre-aggregated, and its join can be split.

A node's sums over its subtree need no walk through the trie. Whatever a node adds is booked on the turn of its smallest
conversation; added up from each conversation's end to its start, it reaches every ancestor, and a grouping by node adds the
conversations. The one aggregate that can't be merged, the hash of a node's list of conversations, is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.scratch import shared_dir, written
from assayer.operators.ranking import ranked

NODE = ["depth", "conv_id"]


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, place, turn_key, n_bytes``: each conversation's turns from place 0, by ``turn``, null first, ties by the turn's digest.

    ``turn_key`` is the SHA-256 of role and text, null ones as empty; ``n_bytes`` are the UTF-8 bytes of the text. Rows without a
    conversation are left out; repeated rows are turns of their own.
    """
    shared_dir(turns.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn_key"),
    )
    out = ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "turn_key"])
    return out.select("conv_id", (F.col("row_no") - 1).alias("place"), "turn_key", "n_bytes")


def _named(rows: DataFrame, by: list[str], value: str, name: str, keep: list[str]) -> DataFrame:
    """``keep`` and the smallest ``value`` of the row's group as ``name``.

    The hash is one more key of the join, as the grouping's exchange would else serve the join too, and a skewed join is only
    split where both sides have exchanges of their own.
    """
    least = rows.groupBy(*by).agg(F.min(value).alias(name)).withColumn("_hash", F.xxhash64(*by))
    return rows.withColumn("_hash", F.xxhash64(*by)).join(least, [*by, "_hash"]).select(*keep, name)


def _blocks(turns: DataFrame, conversations: DataFrame, longest: int) -> list[DataFrame]:
    """For each k the blocks of 2**k turns that begin at a multiple of 2**k: ``conv_id, at`` (in blocks), ``block``."""
    starts = ranked(conversations, [], ["conv_id"], sums=["n_turns"]).select("conv_id", (F.col("n_turns_to") - F.col("n_turns")).alias("_start"))
    numbered = turns.join(starts, "conv_id").select("conv_id", F.col("place").alias("at"), "turn_key", (F.col("_start") + F.col("place")).alias("number"))
    levels = [written(_named(numbered, ["turn_key"], "number", "block", ["conv_id", "at", "number"]), "block0")]
    while 2 ** len(levels) <= longest:
        odd = F.col("at") % 2 == 1
        pairs = levels[-1].groupBy("conv_id", F.floor(F.col("at") / 2).alias("at")).agg(
            F.max(F.when(~odd, F.col("block"))).alias("left"), F.max(F.when(odd, F.col("block"))).alias("right"), F.min("number").alias("number")
        ).where("right is not null")
        levels.append(written(_named(pairs, ["left", "right"], "number", "block", ["conv_id", "at", "number"]), f"block{len(levels)}"))
    return [b.drop("number") for b in levels]


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, name``: for each conversation and number of its turns from 0 the smallest conversation with the same first turns.

    ``turns`` is as ``ordered`` returns it, ``conversations`` has each ``conv_id`` once and its ``n_turns``.
    """
    least, longest = conversations.agg(F.min("conv_id"), F.coalesce(F.max("n_turns"), F.lit(0))).first()
    known = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("name"))
    if not longest:
        return written(known, "prefix")
    blocks = _blocks(turns, conversations, longest)
    for k in range(len(blocks) - 1, -1, -1):
        size = 1 << k
        even = blocks[k].where("at % 2 = 0").select("conv_id", (F.col("at") * size).alias("depth"), "block")
        longer = known.join(even, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + size).alias("depth"), F.col("name").alias("shorter"), "block")
        known = written(known.unionByName(_named(longer, ["depth", "shorter", "block"], "conv_id", "name", ["conv_id", "depth"])), f"prefix{k}")
    return known


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a node as one comma-joined text, of one batch at most."""
    for batch in batches:
        node, texts, out = None, [], []
        for *at, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "conv_id")), strict=True):
            if at != node:
                if texts:
                    out.append((*node, first, ",".join(texts)))
                node, first, texts = at, conv, []
            texts.append(str(conv))
        if texts:
            out.append((*node, first, ",".join(texts)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "name", "first", "piece"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        out = []
        for *at, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "piece")), strict=True):
            if at == node:
                state.update(b"," + piece.encode())
                continue
            if node:
                out.append((*node, state.hexdigest()))
            node, state = at, hashlib.sha256(piece.encode())
        yield _hashes(out)
    if node:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "name", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of the nodes where conversations end. A node's list is cut in ranges into pieces, which a task reads
    as a stream: SHA-256 can't be merged, but no list is held whole."""
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = last.repartitionByRange(n, "depth", "name", "conv_id").sortWithinPartitions("depth", "name", "conv_id").select("depth", "name", "conv_id").mapInArrow(_pieces, "depth long, name long, first long, piece string")
    return pieces.repartition(n, "depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(_streamed, "depth long, name long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns``, as ``prefix_trie`` describes them; for the arguments see ``prefixes``."""
    rows = prefixes(turns, conversations)
    nodes = rows.groupBy("depth", F.col("name").alias("conv_id")).agg(F.count("*").alias("n_convs"))
    above = rows.select((F.col("depth") + 1).alias("depth"), "conv_id", F.col("name").alias("parent_conv_id"))
    size = turns.select((F.col("place") + 1).alias("depth"), "conv_id", "n_bytes")
    nodes = nodes.join(above, NODE, "left").join(size, NODE, "left")
    children = nodes.where("parent_conv_id is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own = nodes.select(*NODE, (F.coalesce("n_bytes", F.lit(0)) * (F.col("n_convs") - 1)).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    booked = ranked(rows.join(own, NODE, "left"), ["conv_id"], [F.col("depth").desc()], sums=["saved", "leaf"])
    sums = booked.groupBy("depth", F.col("name").alias("conv_id")).agg(F.sum("saved_to").alias("saved_tokens"), F.sum("leaf_to").alias("n_leaves"))
    last = rows.join(conversations.select("conv_id", F.col("n_turns").alias("depth")), NODE, "left_semi")
    ends = _ends(last).withColumnRenamed("name", "conv_id")
    out = nodes.join(sums, NODE).join(ends, NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the conversations in ``turns`` (``conv_id, turn, role, text``), from the empty one.

    ``conv_id`` is the smallest conversation with these turns and with ``depth``, their number, names the node; ``parent_conv_id``
    names its parent, null for the root. ``n_convs`` have these turns, ``n_children`` nodes are one turn longer, ``n_leaves`` nodes
    of the subtree have none longer. ``saved_tokens`` are the bytes that keeping each turn of the subtree once saves;
    ``ends_sha256`` is the hash of the conversations that have no further turn, comma-joined in ascending order.

    Turns are ordered by ``turn``, null first; null roles and texts are empty. Rows without a conversation are left out. Without
    rows there is no node. Further columns are not read.
    """
    placed = written(ordered(turns), "turns")
    return trie(placed, placed.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
