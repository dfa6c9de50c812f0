"""Matched contrasts between experiments: which samples compare, how the arms differ on them, and how sure that is."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.verdicts import direction, family, family_slug, variant
from assayer.operators.geometry import SIGNATURES

#: The measures that contrasts are judged by; findings rest on the first six.
PRIMARY = ("abstain_rate", "singleton_rate", "mean_subset_size", "mean_expected_stage", "mid_scale_mass", "stage_entropy")
ENDPOINTS = (*PRIMARY, "mean_agreement")


def paired_families(samples: DataFrame) -> DataFrame:
    """``contrast_id, baseline_tag, variant_tag``: tags ``v3_a1_x`` and ``v3_b1_x`` of one x."""
    tags = samples.select("experiment_tag").distinct().select("experiment_tag", F.get(F.split("experiment_tag", "_"), F.lit(1)).alias("code"), F.get(F.split("experiment_tag", "_"), F.lit(2)).alias("x"))
    a, b = (tags.where(F.col("code") == c).select("x", F.col("experiment_tag").alias(n)) for c, n in (("a1", "baseline_tag"), ("b1", "variant_tag")))
    return a.join(b, "x").select(F.concat(F.lit("toggle_"), "x").alias("contrast_id"), "baseline_tag", "variant_tag")


def matching(samples: DataFrame, contrasts: DataFrame, strict: bool = False) -> DataFrame:
    """``contrast_id, sample_ordinal, has_baseline, has_variant, comparable`` and whether each signature matches: a full outer match of the arms.

    Samples compare if both arms have them, of the same windows and bundle sizes, and have as many responses; strictly, if their
    bundles are the same too, however many responses there are. Signatures that ``samples`` lack are not compared.
    """
    marks = [c for c in ("bundle_signature", *SIGNATURES.values(), "response_rows") if c in samples.columns]

    def arm(side: str) -> DataFrame:
        m = samples.select(F.col("experiment_tag").alias(f"{side}_tag"), "sample_ordinal", F.lit(True).alias(f"_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in marks))
        return contrasts.join(m, f"{side}_tag").select("contrast_id", "sample_ordinal", f"_{side}", *(f"{side}_{c}" for c in marks))

    out = arm("baseline").join(arm("variant"), ["contrast_id", "sample_ordinal"], "full_outer")
    match = {c: F.coalesce(F.col(f"baseline_{c}") == F.col(f"variant_{c}"), F.lit(False)) for c in marks}
    needed = [match[c] for c in marks if c != ("response_rows" if strict else "bundle_signature")]
    here = lambda side: F.coalesce(F.col(f"_{side}"), F.lit(False)).alias(f"has_{side}")
    return out.select("contrast_id", "sample_ordinal", here("baseline"), here("variant"), functools.reduce(lambda x, y: x & y, needed).alias("comparable"), *(m.alias(f"{c}_match") for c, m in match.items()))


#: What a report says of a contrast's matching, if all samples compare and if not, by window and strictly.
NOTES = {
    False: ("All samples matched on window/bundle-size signatures; bundle memberships intentionally differ.", "Some samples mismatch on window/bundle-size signatures or are missing in one condition."),
    True: ("All samples matched on bundle/window signatures.", "Some samples mismatch on bundle/window signatures or are missing in one condition."),
}


def matching_validation(matched: DataFrame, strict: bool = False) -> DataFrame:
    """Per contrast: samples of each arm, those that compare, whether all do, and a note for the report."""
    count = lambda c: F.count_if(F.col(c))
    out = matched.groupBy("contrast_id").agg(
        count("has_baseline").alias("n_baseline"), count("has_variant").alias("n_variant"), count("comparable").alias("n_matched"), F.bool_and("comparable").alias("fully_matched")
    )
    return out.withColumn("note", F.when(F.col("fully_matched"), NOTES[strict][0]).otherwise(NOTES[strict][1]))


def pair_deltas(samples: DataFrame, contrasts: DataFrame, matched: DataFrame) -> DataFrame:
    """``contrast_id, sample_ordinal, endpoint, baseline, variant, delta`` on comparable samples."""
    long = samples.select("experiment_tag", "sample_ordinal", F.explode(F.create_map(*(x for e in ENDPOINTS for x in (F.lit(e), F.col(e).cast("double"))))).alias("endpoint", "value"))
    arm = lambda side: long.select(F.col("experiment_tag").alias(f"{side}_tag"), "sample_ordinal", "endpoint", F.col("value").alias(side))
    rows = matched.where("comparable").select("contrast_id", "sample_ordinal").join(contrasts, "contrast_id")
    rows = rows.join(arm("baseline"), ["baseline_tag", "sample_ordinal"]).join(arm("variant"), ["variant_tag", "sample_ordinal", "endpoint"])
    return rows.select("contrast_id", "sample_ordinal", "endpoint", "baseline", "variant", (F.col("variant") - F.col("baseline")).alias("delta"))


def effects(deltas: DataFrame) -> DataFrame:
    """Per contrast and endpoint: n, mean, median, deviation, standardised effect, share of gains, and a normal p-value's statistic."""
    rows = deltas.where("delta is not null")
    out = rows.groupBy("contrast_id", "endpoint").agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.percentile("delta", F.lit(0.5)).alias("median_delta"),
        F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("std_delta"), F.avg((F.col("delta") > 1e-12).cast("double")).alias("positive_share"),
    )
    return out.withColumn("dz", F.when(F.col("std_delta") > 0, F.col("mean_delta") / F.col("std_delta")))


def registry(samples: DataFrame) -> DataFrame:
    """The contrasts with what a report says of them: family, kind, labels of the arms and how samples are matched."""
    out = paired_families(samples)
    arm = lambda side: F.concat_ws(" ", family(F.col(f"{side}_tag")), variant(F.col(f"{side}_tag"))).alias(f"{side}_label")
    return out.select("contrast_id", family_slug(F.col("baseline_tag")).alias("family_slug"), F.lit("toggle").alias("contrast_kind"), "baseline_tag", "variant_tag", arm("baseline"), arm("variant"), F.lit("window_only").alias("match_mode"))


def q_values(rows: DataFrame, p: str = "p_value", keys: tuple[str, ...] = (), tie: str = "endpoint") -> DataFrame:
    """``rows`` with Benjamini-Hochberg ``q_value`` over each key's p-values, and whether it is at most 0.1 and 0.05; a null p has none."""
    by = Window.partitionBy(*(keys or (F.lit(0),)))
    ranked = rows.withColumn("_rank", F.row_number().over(by.orderBy(F.asc_nulls_last(p), tie))).withColumn("_n", F.count(p).over(by))
    down = by.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down))
    out = ranked.withColumn("q_value", F.when(F.col(p).isNotNull(), q)).drop("_rank", "_n")
    return out.withColumns({f"is_significant_fdr_{d}": F.coalesce(F.col("q_value") <= limit, F.lit(False)) for d, limit in (("10", 0.10), ("05", 0.05))})


def ranked_findings(effects_: DataFrame, top: int = 25) -> DataFrame:
    """The first effects by q-value, then by significance, standardised size and absolute mean; ties by name."""
    dz, mean = F.abs(F.coalesce("dz", F.lit(0.0))), F.abs("mean_delta")
    sure = [F.col(f"is_significant_fdr_{d}") for d in ("05", "10")]
    score = 3 * sure[0].cast("int") + 2 * sure[1].cast("int") + dz + 0.1 * mean
    order = [F.asc_nulls_last(F.round("q_value", 9)), sure[0].desc(), sure[1].desc(), F.desc(F.round(F.abs("dz"), 9)), F.desc(F.round(mean, 9)), "contrast_id", "endpoint"]
    return effects_.withColumn("rank_score", score).withColumn("direction", direction(F.round("mean_delta", 9))).orderBy(*order).limit(top)


def effect_contributors(deltas: DataFrame, findings: DataFrame, top: int = 25) -> DataFrame:
    """Samples by the sum of their absolute differences in the contrasts and endpoints of ``findings``, then by the largest and their
    number: the ``top`` of them, with the name of the largest (of equal ones, the first by name)."""
    size = F.abs("delta")
    rows = deltas.where("delta is not null").join(F.broadcast(findings.select("contrast_id", "endpoint")), ["contrast_id", "endpoint"])  # a ranking's rows
    rows = rows.withColumn("key", F.concat_ws(" | ", "contrast_id", "endpoint"))
    out = rows.groupBy("sample_ordinal").agg(F.sum(size).alias("total"), F.max(size).alias("largest"), F.count("*").alias("n"), F.min_by("key", F.struct(-F.round(size + 3.7e-10, 9), "key")).alias("largest_key"))
    return out.orderBy(F.desc(F.round("total", 6)), F.desc(F.round("largest", 6)), F.desc("n"), "sample_ordinal").limit(top)
