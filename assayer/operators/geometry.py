"""Verdict geometry: how verdicts spread over the stages of their scale, by experiment, sample, bundle and shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.verdicts import bucket, expected_stage, has, label
from assayer.operators.belief import WORLDS, worlds
from assayer.operators.ranking import order_statistics, value_counts
from assayer.sources.checkpoints import checkpointed

SAMPLE = ["experiment_tag", "sample_ordinal"]


def _some() -> Column:
    return F.col("mask") != 0


def stage_mass(responses: DataFrame, keys: list[str], of_all: bool) -> DataFrame:
    """``keys, scale_size, stage, mass``: each verdict spreads 1 evenly over its stages.

    The denominator is all responses, or only those with a verdict. Every stage of the scale has a row; a group without verdicts
    has masses 0. Null keys form a group.
    """
    weight = F.when(has(F.col("mask"), F.col("stage")), 1 / F.bit_count("mask")).otherwise(0.0)
    n = F.count("*") if of_all else F.count(F.when(_some(), 1))
    rows = responses.withColumn("stage", F.explode(F.sequence(F.lit(1), F.col("scale_size").cast("int"))))
    return rows.groupBy(*keys, "scale_size", "stage").agg(F.coalesce(F.try_divide(F.sum(weight), n.cast("double")), F.lit(0.0)).alias("mass"))


def mass_shape(mass: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, mid_scale_mass, stage_entropy``: mass strictly inside the scale, and entropy over that of an even spread."""
    m, n = F.col("mass"), F.col("scale_size")
    inside = F.when((F.col("stage") > 1) & (F.col("stage") < n), m).otherwise(0.0)
    return mass.groupBy(*keys).agg(F.sum(inside).alias("mid_scale_mass"), (F.sum(F.when(m > 0, -m * F.log2(m)).otherwise(0.0)) / F.log2(F.max(n))).alias("stage_entropy"))


def experiment_geometry(responses: DataFrame, stages: int = 9) -> DataFrame:
    """Mass of each stage from 1 to ``stages``, of abstentions and inside the scale, and entropy. A larger scale is an error."""
    mass = stage_mass(responses, ["experiment_tag"], of_all=True)
    large = F.when(F.max("scale_size") > stages, F.raise_error(F.lit("a scale has more stages than columns")).cast("double"))
    wide = mass.groupBy("experiment_tag").agg(F.coalesce(large, 1 - F.sum("mass")).alias("abstain_mass"), *(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("mass"))), F.lit(0.0)).alias(f"mass_stage_{s}") for s in range(1, stages + 1)))
    return wide.join(mass_shape(mass, ["experiment_tag"]), "experiment_tag")


def _rates() -> list[Column]:
    single = F.when(_some(), (F.bit_count("mask") == 1).cast("double"))
    return [
        F.count("*").alias("response_rows"),
        F.avg((~_some()).cast("double")).alias("abstain_rate"),
        F.avg(single).alias("singleton_rate"),
        F.avg(F.when(_some(), F.bit_count("mask"))).alias("mean_subset_size"),
        F.avg(expected_stage(F.col("mask"), F.col("scale_size"))).alias("mean_expected_stage"),
        F.avg("agreement").alias("mean_agreement"),
    ]


def experiment_metrics(responses: DataFrame) -> DataFrame:
    return responses.groupBy("experiment_tag").agg(*_rates(), F.countDistinct("sample_ordinal").alias("samples"), F.countDistinct("bundle_no").alias("bundles"), F.avg("obs").alias("mean_observability"), F.avg("disc").alias("mean_discriminability"))


#: What else samples are matched by: columns of responses and their signatures.
SIGNATURES = {"window_id": "window_signature", "bundle_size": "bundle_size_signature"}


def sample_metrics(responses: DataFrame, stages: int = 9) -> DataFrame:
    """One row per experiment and sample, from one grouping; the signature lists its bundles, sorted as text, as do those of windows and
    bundle sizes where responses have ``window_id`` and ``bundle_size``.

    Stages are added up side by side, so responses aren't multiplied by stages. A scale of more than ``stages`` is an error.
    """
    listed = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))  # a sample's bundles are few
    signatures = [F.array_join(listed(c), " | ").alias(name) for c, name in SIGNATURES.items() if c in responses.columns]
    spread = [F.sum(F.when(has(F.col("mask"), F.lit(s)), 1 / F.bit_count("mask")).otherwise(0.0)).alias(f"_m{s}") for s in range(1, stages + 1)]
    large = F.when(F.max("scale_size") > stages, F.raise_error(F.lit("a scale has more stages than columns")).cast("int"))
    rows = responses.groupBy(*SAMPLE).agg(*_rates(), *signatures, listed("bundle_no").alias("_bundles"), *spread, F.count(F.when(_some(), 1)).alias("_verdicts"), F.coalesce(large, F.max("scale_size")).alias("_n"))
    masses = F.transform(F.array(*(f"_m{s}" for s in range(1, stages + 1))), lambda m: F.coalesce(F.try_divide(m, F.col("_verdicts").cast("double")), F.lit(0.0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda x, m: x + m)
    inside = total(F.transform("_masses", lambda m, i: F.when((i > 0) & (i < F.col("_n") - 1), m).otherwise(0.0)))
    entropy = total(F.transform("_masses", lambda m: F.when(m > 0, -m * F.log2(m)).otherwise(0.0))) / F.log2("_n")
    return rows.withColumn("_masses", masses).select(
        *SAMPLE, *(c for c in rows.columns if c not in SAMPLE and not c.startswith("_")), F.size("_bundles").cast("long").alias("unique_bundle_count"),
        F.array_join("_bundles", " | ").alias("bundle_signature"), inside.alias("mid_scale_mass"), entropy.alias("stage_entropy"),
    )


def evidence_metrics(responses: DataFrame) -> DataFrame:
    return responses.groupBy(*SAMPLE, "bundle_no").agg(*_rates())


def bundle_verdict_profiles(responses: DataFrame) -> DataFrame:
    """Verdicts of each experiment and bundle, and the share each has of its bundle."""
    rows = responses.groupBy("experiment_tag", "bundle_no", label(F.col("mask"), F.col("scale_size")).alias("verdict")).agg(F.count("*").alias("n"), F.avg("agreement").alias("mean_agreement"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("experiment_tag", "bundle_no")))


def verdict_certainty(responses: DataFrame) -> DataFrame:
    shape = bucket(F.col("mask"), F.col("scale_size"))
    rows = responses.groupBy("experiment_tag", "scale_size", label(F.col("mask"), F.col("scale_size")).alias("verdict"), shape.alias("bucket")).agg(F.count("*").alias("n"), F.avg("agreement").alias("mean_agreement"), F.avg("obs").alias("mean_observability"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("experiment_tag")))


def with_belief(samples: DataFrame, responses: DataFrame) -> DataFrame:
    """Sample metrics with the conflict and expected stage of both belief worlds; null where a sample has no belief."""
    found = [f(f"{w}_{c}").alias(f"{w}_{c}") for w in WORLDS for c, f in (("conflict", F.max), ("expected_stage", F.sum))]
    return samples.join(worlds(responses, SAMPLE).groupBy(*SAMPLE).agg(*found), SAMPLE, "left")


def experiment_conflicts(metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """Experiment metrics with the mean conflicts of the experiment's samples."""
    names = ("tbm_conflict", "closed_world_conflict")
    return metrics.join(samples.groupBy("experiment_tag").agg(*(F.avg(c).alias(f"mean_{c}") for c in names)), "experiment_tag", "left")


def robust_panel(responses: DataFrame) -> DataFrame:
    """Median, quartile range and trimmed mean over each experiment's responses, of size and stage over those with a verdict.

    All come from the counts of the measures' values, so no experiment is sorted or gathered as a whole.
    """
    rows = responses.select("experiment_tag", (F.col("mask") == 0).cast("double").alias("abstained"), F.when(_some(), F.bit_count("mask")).cast("double").alias("subset_size"), expected_stage(F.col("mask"), F.col("scale_size")).alias("expected_stage"), F.col("agreement").cast("double").alias("certainty"))
    values, by = ["subset_size", "expected_stage", "certainty"], ["experiment_tag"]
    found = order_statistics(value_counts(rows, by, values), by, values, {"q1": 0.25, "median": 0.5, "q3": 0.75}, trim=0.1)
    panel = found.select(*by, *(x for v in values for x in (f"{v}_median", (F.col(f"{v}_q3") - F.col(f"{v}_q1")).alias(f"{v}_iqr"), f"{v}_trimmed_mean")))
    return rows.groupBy(*by).agg(F.avg("abstained").alias("abstain_rate")).join(panel, by, "left")


INSTABLE = ("abstain_rate", "singleton_rate", "mean_subset_size", "mean_expected_stage", "tbm_conflict", "closed_world_conflict")


def sample_instability(samples: DataFrame) -> DataFrame:
    """How much the experiments differ on each sample: deviations, 0 for a single value, and the sum of the first four. ``samples`` has a row an experiment and sample."""
    out = samples.groupBy("sample_ordinal").agg(F.count("experiment_tag").alias("experiments"), *(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in INSTABLE))
    return out.withColumn("instability", sum((F.col(f"{m}_std") for m in INSTABLE[:4]), F.lit(0.0)))


DISTANT = ("abstain_rate", "singleton_rate", "mean_subset_size", "mean_agreement", "mean_tbm_conflict", "mean_closed_world_conflict")


def experiment_distances(metrics: DataFrame) -> DataFrame:
    """Euclidean distance of every pair of experiments over standardised metrics; a null is the column's mean."""
    metrics = checkpointed(metrics.select("experiment_tag", *DISTANT))  # else both sides of the join would make them
    all_ = Window.partitionBy(F.lit(0))  # one row an experiment
    z = metrics.select("experiment_tag", *(F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(all_), F.stddev_pop(c).over(all_)), F.lit(0.0)).alias(c) for c in DISTANT))
    a, b = z.alias("a"), z.alias("b")
    square = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in DISTANT), F.lit(0.0))
    return a.join(b, F.col("a.experiment_tag") < F.col("b.experiment_tag")).select(F.col("a.experiment_tag").alias("left_tag"), F.col("b.experiment_tag").alias("right_tag"), F.sqrt(square).alias("distance"))
