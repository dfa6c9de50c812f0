"""Average linkage, by merging in each round all pairs of clusters that are each other's nearest.

The mean distance of two clusters is the sum of their items' distances over the product of their sizes, so a merge only renames clusters and
adds sums up: a round is a few grouped joins over the table of pairs. As merging two clusters never brings a third nearer than the nearer
of them was, pairs that are nearest to each other stay so, and merging them together gives the tree that merging one pair at a time
gives. Equal distances go by name. The rounds are few unless clusters grow by one item each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ranking import ranked
from assayer.sources.checkpoints import checkpointed

#: Rounds that are replayed before the leaves are written.
REPLAYED = 6


def merges(distances: DataFrame, a: str, b: str, distance: str) -> tuple[DataFrame, int]:
    """``round, left, right, height, n_left, n_right, left_round, right_round``, and the number of rounds.

    ``distances`` has each pair of items once, in either order. A cluster is named by its smallest item; ``left_round`` is the round that made
    the left one, null for an item. Pairs without a distance or of an item with itself say nothing; items that no chain of distances
    connects stay apart.
    """
    rows = distances.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(distance).cast("double").alias("d")).where("a < b and d is not null and not isnan(d)")
    pairs = checkpointed(rows.groupBy("a", "b").agg(F.first("d").alias("total")))
    known = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().select("c", F.lit(1).cast("long").alias("n"), F.lit(None).cast("int").alias("made")))
    done, round_ = None, 0
    side = lambda s: known.select(F.col("c").alias(s), F.col("n").alias(f"n_{s}"), F.col("made").alias(f"made_{s}"))
    while pairs.limit(1).count():
        round_ += 1
        edge = F.struct((F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("d"), "a", "b")
        edges = pairs.join(side("a"), "a").join(side("b"), "b").select(edge.alias("e"), "n_a", "n_b", "made_a", "made_b")
        nearest = edges.select(F.explode(F.array("e.a", "e.b")).alias("c"), "e").groupBy("c").agg(F.min("e").alias("e"))
        both = nearest.groupBy("e").count().where("count = 2").select("e")
        new = checkpointed(edges.join(both, "e").select(
            F.lit(round_).alias("round"), F.col("e.a").alias("left"), F.col("e.b").alias("right"), F.col("e.d").alias("height"),
            F.col("n_a").alias("n_left"), F.col("n_b").alias("n_right"), F.col("made_a").alias("left_round"), F.col("made_b").alias("right_round"),
        ))
        done = new if done is None else done.unionByName(new)
        name = new.select(F.col("right").alias("was"), F.col("left").alias("now"))
        renamed = lambda df, c: df.join(name, df[c] == name["was"], "left").withColumn(c, F.coalesce("now", c)).drop("was", "now")
        pairs = renamed(renamed(pairs, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"))
        grown = new.select(F.col("left").alias("c"), (F.col("n_left") + F.col("n_right")).alias("n"), "round")
        known = known.join(new.select(F.col("right").alias("c")), "c", "left_anti").join(grown.withColumnRenamed("n", "_n"), "c", "left")
        known = checkpointed(known.select("c", F.coalesce("_n", "n").alias("n"), F.coalesce("round", "made").alias("made")))
        pairs = checkpointed(pairs)
    if done is None:
        kind = pairs.schema["a"].dataType.simpleString()
        done = distances.sparkSession.createDataFrame([], f"round int, left {kind}, right {kind}, height double, n_left long, n_right long, left_round int, right_round int")
    return done, round_


def average_linkage(distances: DataFrame, a: str, b: str, distance: str, clusters: int = 4) -> DataFrame:
    """``item, cluster_id, cluster_order``: each item's cluster after the tree is cut into at most that many, and its place in the tree from 0.

    Nodes are numbered, items in order and then merges by height; of two branches the one with the smaller number comes first, and clusters
    are numbered in that order. Merges as high as the last one that the cut keeps are kept as well.
    """
    done, rounds = merges(distances, a, b, distance)
    items = checkpointed(ranked(distances.select(F.explode(F.array(a, b)).alias("item")).where("item is not null").distinct(), [], ["item"]).select("item", (F.col("row_no") - 1).alias("number")))
    n = items.count()
    numbered = checkpointed(ranked(done, [], ["height", "round", "left"]).withColumn("number", F.col("row_no") - 1 + n).drop("row_no", "n_rows"))
    limit = numbered.where(F.col("number") == 2 * n - 1 - min(clusters, n)).select("height").first() if n > clusters else None
    made = numbered.select(F.col("left").alias("c"), F.col("round").alias("r"), F.col("number").alias("m"))

    def number(side: str) -> DataFrame:
        leaf, node = items.select(F.col("item").alias(side), F.col("number").alias("_leaf")), made.select(F.col("c").alias(side), F.col("r").alias(f"{side}_round"), F.col("m").alias("_node"))
        return lambda df: df.join(leaf, side).join(node, [side, f"{side}_round"], "left").withColumn(f"{side}_number", F.coalesce("_node", "_leaf")).drop("_node", "_leaf")

    kept = F.lit(False) if limit is None else F.col("height") <= limit["height"]
    tree = checkpointed(number("right")(number("left")(numbered)).select("round", "left", "right", "n_left", "n_right", (F.col("left_number") < F.col("right_number")).alias("ahead"), kept.alias("kept")))
    leaves = items.select("item", F.col("item").alias("c"), F.col("item").alias("g"), F.lit(0).cast("long").alias("at"))
    for r in range(1, rounds + 1):
        here = tree.where(F.col("round") == r)
        moved = here.select(F.col("left").alias("c"), F.col("left").alias("to"), "kept", F.when(F.col("ahead"), 0).otherwise(F.col("n_right")).alias("by"))
        moved = moved.unionByName(here.select(F.col("right").alias("c"), F.col("left").alias("to"), "kept", F.when(F.col("ahead"), F.col("n_left")).otherwise(0).alias("by")))
        group: Column = F.when(F.col("kept"), F.col("to")).otherwise(F.col("g"))
        leaves = leaves.join(moved, "c", "left").select("item", F.coalesce("to", "c").alias("c"), group.alias("g"), (F.col("at") + F.coalesce("by", F.lit(0))).alias("at"))
        if r % REPLAYED == 0:
            leaves = checkpointed(leaves)
    leaves = checkpointed(ranked(leaves, [], ["c", "at"]).select("item", "g", (F.col("row_no") - 1).alias("cluster_order")))
    groups = ranked(leaves.groupBy("g").agg(F.min("cluster_order").alias("first")), [], ["first"]).select("g", F.col("row_no").alias("cluster_id"))
    return leaves.join(groups, "g").select("item", "cluster_id", "cluster_order")
