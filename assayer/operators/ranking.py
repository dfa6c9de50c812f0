"""Row numbers, running sums, quantiles and trimmed means within keys of any size.

A window over a key sorts the whole key in one task. Here rows are dealt out by ranges of key and order instead, so that a key
with most of the rows lies in many slices. Each slice numbers and adds its own rows; what earlier slices hold of the same key
comes from a table with a row for each key and slice. The slices are drawn from a sample, and so are written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.sources.checkpoints import checkpointed


def joined(a: DataFrame, b: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """``a`` with the further columns of ``b``, joined on ``keys``, where null equals null."""
    keys = list(keys)
    named = b.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    equal = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return a.join(named, equal, how).drop(*(f"_of_{k}" for k in keys))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """``df`` with the row's number from 1 within its key as ``row_no``, the key's rows as ``n_rows``, and for each column c of ``sums``
    the sum up to and with the row as ``c_to`` and over the key as ``c_all``.

    Null keys are a key; nulls in ``sums`` count as 0. Rows that are equal in key and order lie in one slice: let ``order`` tell
    rows apart, or count equal rows beforehand. Without rows the result is empty.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["_slice", *keys]
    dealt = checkpointed(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumns({"_row": F.count(F.lit(1)).over(upto)} | {f"_{c}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) for c in sums})
    held = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_held"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_held_{c}") for c in sums))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # a row a slice at most
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    names = {"_held": "", **{f"_held_{c}": f"_{c}" for c in sums}}
    start = held.select(*by, *(x for h, s in names.items() for x in (F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"_before{s}"), F.sum(h).over(whole).alias(f"_all{s}"))))
    return joined(own, start, by).select(
        *df.columns, (F.col("_row") + F.col("_before")).alias("row_no"), F.col("_all").alias("n_rows"),
        *(x for c in sums for x in ((F.col(f"_{c}") + F.col(f"_before_{c}")).alias(f"{c}_to"), F.col(f"_all_{c}").alias(f"{c}_all"))),
    )


def long_form(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys, name, value``: a row for each value that is not null."""
    rows = df.select(*keys, F.explode(F.create_map(*(x for v in values for x in (F.lit(v), F.col(v).cast("double"))))).alias("name", "value"))
    return rows.where("value is not null")


def value_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys, name, value, n, row_no, n_to, n_all``: how often each value occurs in its key and how many are not above it, however large the key."""
    return ranked(long_form(df, keys, values).groupBy(*keys, "name", "value").agg(F.count("*").alias("n")), [*keys, "name"], ["value"], sums=["n"])


def order_statistics(counts: DataFrame, keys: Sequence[str], values: Sequence[str], quantiles: dict[str, float], trim: float | None = None) -> DataFrame:
    """A row a key with ``<value>_<quantile name>`` for each quantile, by linear interpolation between neighbours, and with ``trim`` also
    ``<value>_trimmed_mean``, without the floor(trim * n) smallest and largest values. ``counts`` comes from ``value_counts``."""
    first, last, n = F.col("n_to") - F.col("n"), F.col("n_to") - 1, F.col("n_all")  # places from 0 that the value takes
    at = {q: F.lit(p) * (n - 1) for q, p in quantiles.items()}
    outs = []
    for v in values:
        mine = F.col("name") == v
        for q, x in at.items():
            low, part = F.floor(x), x - F.floor(x)
            held = lambda place: (first <= place) & (place <= last)
            weight = F.when(held(low), 1 - part).otherwise(0.0) + F.when((part > 0) & held(low + 1), part).otherwise(0.0)
            outs.append(F.sum(F.when(mine & (weight > 0), weight * F.col("value"))).alias(f"{v}_{q}"))
        if trim is not None:
            cut = F.floor(n * trim)
            kept = F.greatest(F.least(last, n - cut - 1) - F.greatest(first, cut) + 1, F.lit(0))
            outs.append((F.sum(F.when(mine, kept * F.col("value"))) / F.sum(F.when(mine, kept))).alias(f"{v}_trimmed_mean"))
    return counts.groupBy(*keys).agg(*outs)
