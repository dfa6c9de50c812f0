"""Opinion pools and how sensitive results are to the way verdicts are aggregated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assayer.functions.verdicts import clamp
from assayer.operators.belief import WORLDS, against, bets, by_key, factor
from assayer.operators.geometry import SAMPLE
from assayer.operators.ranking import order_statistics, value_counts
from assayer.sources.checkpoints import checkpointed

EPSILON = 1e-12
METHODS = ("geometry", "linear", "log", "tbm", "closed_world")


def sample_pools(responses: DataFrame, keys: list[str] = SAMPLE) -> DataFrame:
    """``keys, scale_size`` and for each of five methods its probabilities of the stages as an array, null where it says nothing, and the worlds' conflicts.

    Abstentions take no part in the first three, whose weights are the agreements; where all are 0, all are 1. Probabilities sum to 1, or are
    all 0. All methods come from one pass over the responses.
    """

    def measured(n: int, mask: np.ndarray, of: dict[str, np.ndarray]) -> list[tuple[np.ufunc, np.ndarray]]:
        said = mask > 0
        within = ((mask[:, None] >> np.arange(n)) & 1 == 1) & said[:, None]
        p = np.where(within, 1 / np.maximum(np.bitwise_count(np.maximum(mask, 0)), 1)[:, None], 0.0)
        log = np.where(said[:, None], np.log(np.maximum(p, EPSILON)), 0.0)
        count, weight = np.where(said, of["n"], 0.0)[:, None], np.where(said, of["weight"], 0.0)[:, None]
        return [*(against(n, mask, of[w]) for w in WORLDS), *((np.add, x) for x in (count, weight, count * p, weight * p, count * log, weight * log))]

    def found(n: int, tbm: np.ndarray, closed: np.ndarray, count: np.ndarray, weight: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
        none, all_, some = count[:, 0] == 0, np.maximum(count, 1), weight > 0
        share = np.where(some, weight, all_)
        log = np.exp(np.where(some, sums[3], sums[2]) / share)
        three = [sums[0] / all_, np.where(some, sums[1], sums[0]) / share, log / log.sum(axis=1)[:, None]]
        world = [bets(n, q) for q in (tbm, closed)]
        absent = np.zeros(len(none), bool)
        arrays = [np.ma.array(x, mask=np.broadcast_to(m[:, None], x.shape)) for x, m in zip([*three, *(bet for bet, _ in world)], [none, none, none, absent, none], strict=True)]
        return [*arrays, world[0][1], np.ma.array(world[1][1], mask=none)]

    columns = {m: ArrayType(DoubleType()) for m in METHODS} | {f"{w}_conflict": DoubleType() for w in WORLDS}
    sums = {"n": F.lit(1.0), "weight": clamp(F.col("agreement"))}
    return by_key(responses, keys, {w: factor(closed) for w, closed in WORLDS.items()}, sums, measured, found, **columns)


def _conflict(method: str) -> Column:
    return F.col(f"{method}_conflict") if method in WORLDS else F.lit(None).cast("double")


def pooled(responses: DataFrame, keys: list[str] = SAMPLE) -> DataFrame:
    """``keys, method, stage, p, conflict``: ``sample_pools`` with a row a method and stage."""
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("p"), _conflict(m).alias("conflict")) for m in METHODS))
    rows = sample_pools(responses, keys).select(*keys, F.explode(each).alias("m")).where("m.p is not null")
    return rows.select(*keys, "m.method", "m.conflict", F.posexplode("m.p").alias("at", "p")).select(*keys, "method", (F.col("at") + 1).alias("stage"), "p", "conflict")


def methods_beside(responses: DataFrame, keys: list[str] = SAMPLE) -> DataFrame:
    """``keys, methods``: of each key an array of what its methods say: ``method, expected_stage, top_p, conflict``; the numbers are null where one says nothing."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)

    def said(m: str) -> Column:
        s, mean = total(F.col(m)), total(F.transform(m, lambda p, i: (i + 1) * p))
        return F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("method"), F.when(s > 0, mean / s).alias("expected_stage"), F.when(s > 0, F.array_max(m) / s).alias("top_p"), _conflict(m).alias("conflict")))

    return sample_pools(responses, keys).select(*keys, F.filter(F.array(*map(said, METHODS)), lambda x: x.isNotNull()).alias("methods"))


def sample_methods(beside: DataFrame, keys: list[str] = SAMPLE) -> DataFrame:
    """``keys, method, expected_stage, top_p, conflict``: ``methods_beside`` with a row a method."""
    return beside.select(*keys, F.explode("methods").alias("m")).select(*keys, "m.*")


def method_summary(methods: DataFrame) -> DataFrame:
    return methods.groupBy("experiment_tag", "method").agg(F.count("*").alias("n"), F.avg("expected_stage").alias("mean_expected_stage"), F.avg("top_p").alias("mean_top_p"), F.avg("conflict").alias("mean_conflict"))


def method_alignment(beside: DataFrame, reference: str = "linear") -> DataFrame:
    """Mean absolute and signed difference of each method's expected stage from the reference method's, on the same samples."""
    base = F.filter("methods", lambda m: m["method"] == reference)
    rows = beside.select("experiment_tag", F.explode("methods").alias("m"), base.alias("base")).where((F.col("m.method") != reference) & (F.size("base") > 0))
    d = F.col("m.expected_stage") - F.get("base", F.lit(0))["expected_stage"]
    return rows.select("experiment_tag", "m.method", d.alias("d")).groupBy("experiment_tag", "method").agg(F.avg(F.abs("d")).alias("mean_absolute"), F.avg("d").alias("bias"), F.count("d").alias("n"))


def contrast_sensitivity(beside: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Paired difference of the arms of each contrast by method: n, mean, median and population deviation. Contrasts are few."""
    beside = checkpointed(beside.select("experiment_tag", "sample_ordinal", "methods"))  # else each arm would make it
    arm = lambda side: beside.select(F.col("experiment_tag").alias(f"{side}_tag"), "sample_ordinal", F.col("methods").alias(side))
    rows = F.broadcast(contrasts).join(arm("baseline"), "baseline_tag").join(arm("variant"), ["variant_tag", "sample_ordinal"])
    rows = rows.select("contrast_id", "baseline", F.explode("variant").alias("v"))
    same = F.get(F.filter("baseline", lambda b: b["method"] == F.col("v.method")), F.lit(0))
    rows = checkpointed(rows.select("contrast_id", F.col("v.method").alias("method"), (F.col("v.expected_stage") - same["expected_stage"]).alias("d")).where("d is not null"))
    by = ["contrast_id", "method"]
    medians = order_statistics(value_counts(rows, by, ["d"]), by, ["d"], {"median": 0.5}).withColumnRenamed("d_median", "median_delta")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.stddev_pop("d").alias("std_delta")).join(medians, by)
    return out.select(*by, "n", "mean_delta", "median_delta", "std_delta")
