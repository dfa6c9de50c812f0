"""Report tables: rates, counts and matrices, weighted belief, divergences, outliers, rankings and length bias."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assayer.functions.verdicts import bucket, family, family_slug, label, rounded, stages_of
from assayer.operators.belief import against, bets, by_key, factor
from assayer.operators.geometry import SAMPLE
from assayer.operators.ranking import joined, ranked
from assayer.operators.regression import least_squares
from assayer.sources.checkpoints import checkpointed

#: What is added to each probability before two distributions are compared.
EPSILON = 1e-8
OUTLYING = 1.5
#: What a tag may hold, first match first, and its mark on a focus label; the mark of an abstracted view comes last.
MARKS = (
    ("abstain_true", "A+"), ("abstain_false", "A-"), ("illiberal_democracy", "illib"), ("control", "ctl"), ("cluster_l3", "cl3"),
    ("cluster_l2", "cl2"), ("random_l2", "rand"), ("scale_9", "s9"), ("scale_7", "s7"), ("scale_5", "s5"),
)
ABSTRACTED = ("l3_abstracted", "l3")


def family_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Per family: its experiments and the mean of each column over them."""
    return metrics.groupBy(family(F.col("experiment_tag")).alias("family_code"), family_slug(F.col("experiment_tag")).alias("family_slug")).agg(F.count("*").alias("experiments"), *(F.avg(c).alias(c) for c in columns))


def bundle_rates(responses: DataFrame, total: bool = False) -> DataFrame:
    """Abstentions and single stages of each bundle; with ``total``, a row without a bundle for the experiment as a whole."""
    rates = [F.count("*").alias("n"), F.avg((F.col("mask") == 0).cast("double")).alias("abstain_rate"), F.avg(F.when(F.col("mask") != 0, (F.bit_count("mask") == 1).cast("double"))).alias("singleton_rate")]
    rows = responses.where("bundle_no is not null")
    return (rows.groupingSets([["experiment_tag", "bundle_no"], ["experiment_tag"]], "experiment_tag", "bundle_no") if total else rows.groupBy("experiment_tag", "bundle_no")).agg(*rates)


def stage_counts(responses: DataFrame) -> DataFrame:
    """``experiment_tag, bundle_no, stage, n``: how often each stage was named, or ``ABSTAIN``; every stage of the scale has a row."""
    every = responses.select("experiment_tag", "bundle_no", "scale_size").distinct()
    every = every.select("experiment_tag", "bundle_no", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.col("scale_size").cast("int")), lambda s: s.cast("string")), F.array(F.lit("ABSTAIN")))).alias("stage"))
    named = F.when(F.col("mask") == 0, F.array(F.lit("ABSTAIN"))).otherwise(stages_of(F.col("mask"), F.col("scale_size")).cast("array<string>"))
    counts = responses.select("experiment_tag", "bundle_no", F.explode(named).alias("stage")).groupBy("experiment_tag", "bundle_no", "stage").agg(F.count("*").alias("n"))
    return every.join(counts, ["experiment_tag", "bundle_no", "stage"], "left").na.fill(0, ["n"])


def bucket_heatmap(certainty: DataFrame) -> DataFrame:
    """Verdicts summed up by shape: responses, the largest verdict, and the mean of the verdicts' mean agreements."""
    return certainty.groupBy("experiment_tag", "bucket").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.avg("mean_agreement").alias("mean_agreement"))


def verdict_matrix(responses: DataFrame) -> DataFrame:
    """Of each bundle and verdict the responses and their mean agreement, where a missing one counts as 1."""
    verdict = label(F.col("mask"), F.col("scale_size")).alias("verdict")
    return responses.groupBy("experiment_tag", "bundle_no", verdict).agg(F.count("*").alias("n"), F.avg(F.coalesce("agreement", F.lit(1.0)).cast("double")).alias("mean_agreement"))


def conflict_summary(combined: DataFrame) -> DataFrame:
    """Per experiment: combinations, the share of use, mean and median conflict, and the mean of the largest probabilities."""
    return combined.groupBy("experiment_tag").agg(
        F.count("*").alias("n"), F.avg(F.col("usable").cast("double")).alias("usable_share"), F.avg("conflict").alias("mean_conflict"),
        F.percentile("conflict", F.lit(0.5)).alias("median_conflict"), F.avg("max_bet_p").alias("mean_conviction"),
    )


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, at: tuple[float, ...]) -> DataFrame:
    """``keys, q<percent>``: quantiles of each key's values, linear between points at their shares of the running weight, constant beyond.

    Every row is a point, also of weight 0; equal values go by weight. Where all weights are 0, quantiles are those without weights.
    Rows with a null or non-finite value or weight take no part. Keys may be of any size.
    """
    v, w = (F.col(c).cast("double") for c in (value, weight))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = rows.select(*keys, v.alias("v"), w.alias("w")).where(finite(F.col("v")) & finite(F.col("w")))
    return _quantiles(some.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.sum("w").alias("nw"), F.min("w").alias("w")), keys, at)


def _quantiles(points: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """``weighted_quantiles`` of values that have ``n`` points, of weight ``nw`` together and ``w`` at least.

    Between the first and the last point of a value lies that value, so points between them make no difference.
    """
    points = ranked(points, keys, ["v"], sums=["n", "nw"])
    none = F.col("nw_all") <= 0
    last = F.when(none, (F.col("n_to") - 1) / F.greatest(F.col("n_all") - 1, F.lit(1))).otherwise(F.try_divide("nw_to", "nw_all"))
    first = F.when(none, (F.col("n_to") - F.col("n")) / F.greatest(F.col("n_all") - 1, F.lit(1))).otherwise(F.try_divide(F.col("nw_to") - F.col("nw") + F.col("w"), F.col("nw_all")))
    ends = points.select(*keys, "v", F.explode(F.array(first, last)).alias("c"))
    point = F.struct("v", "c")
    out = ends.groupBy(*keys).agg(*(f(F.when(side, point)).alias(f"{name}{i}") for i, q in enumerate(at) for name, f, side in (("low", F.max, F.col("c") <= q), ("high", F.min, F.col("c") > q))))

    def quantile(i: int, q: float) -> Column:
        low, high = (lambda f: F.col(f"low{i}.{f}")), (lambda f: F.col(f"high{i}.{f}"))
        between = low("v") + (q - low("c")) / (high("c") - low("c")) * (high("v") - low("v"))
        return F.when(F.col(f"low{i}").isNull(), high("v")).when(F.col(f"high{i}").isNull(), low("v")).otherwise(between).alias(f"q{round(q * 100)}")

    return out.select(*keys, *(quantile(i, q) for i, q in enumerate(at)))


def rubric_weights(responses: DataFrame, usable: float = 0.9) -> DataFrame:
    """``experiment_tag, sample_ordinal, w, scales`` of the rubrics (samples) whose conflict is low enough to be of use: how many scales they have, and
    the mean of observability times discriminability, to nine digits; 0 if that is missing or negative."""
    both = (F.col("obs") * F.col("disc")).cast("double")
    sums = {"n": both.isNotNull().cast("double"), "x": F.coalesce(both, F.lit(0.0))}

    def measured(n: int, mask: np.ndarray, of: dict[str, np.ndarray]) -> list[tuple[np.ufunc, np.ndarray]]:
        return [against(n, mask, of["factor"]), (np.add, of["n"]), (np.add, of["x"])]

    columns = {c: DoubleType() for c in ("conflict", "n", "x")}
    rows = by_key(responses, SAMPLE, {"factor": factor(False)}, sums, measured, lambda n, q, k, x: [bets(n, q)[1], k, x], **columns)
    rows = rows.groupBy(*SAMPLE).agg(F.max("conflict").alias("conflict"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").cast("double").alias("scales"))
    mean = F.greatest(F.coalesce(rounded(F.try_divide("x", "n")), F.lit(0.0)), F.lit(0.0))
    return rows.where(rounded(F.col("conflict")) < usable).select(*SAMPLE, mean.alias("w"), "scales")


def weighted_belief(responses: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Per experiment, bundle and stage: mean, 10 % and 90 % quantile of the bundle's probabilities by rubric, by the rubrics' weights.

    ``rubrics`` is what ``rubric_weights`` returns; where all weights are 0, each counts 1. Equal probabilities, to nine digits, of a bundle's stage are
    added up at once, so what is then ordered and written has a row for each of them.
    """
    keys = ["experiment_tag", "bundle_no", "stage"]
    rubrics = checkpointed(rubrics, collect=True)

    def measured(n: int, mask: np.ndarray, of: dict[str, np.ndarray]) -> list[tuple[np.ufunc, np.ndarray]]:
        return [against(n, mask, of["factor"]), (np.maximum, of["w"]), (np.maximum, of["scales"])]

    columns = {"bet": ArrayType(DoubleType()), "w": DoubleType(), "scales": DoubleType()}
    rows = by_key(responses, [*SAMPLE, "bundle_no"], {"factor": factor(False)}, {}, measured, lambda n, q, w, k: [bets(n, q)[0], w, k], rubrics, **columns)
    rows = rows.select("experiment_tag", "sample_ordinal", "bundle_no", "w", "scales", F.posexplode("bet").alias("at", "bet_p"))
    several = F.when(F.col("scales") > 1, F.col("sample_ordinal")).alias("several")  # a sample of two scales has two rows, but counts once
    equal = rows.groupBy("experiment_tag", "bundle_no", (F.col("at") + 1).alias("stage"), rounded(F.col("bet_p"), nudge=3.7e-13).alias("v"), several).agg(
        F.count("*").alias("n"), F.count("sample_ordinal").alias("rubrics"), F.sum("w").alias("nw"), F.min("w").alias("w"),
        F.sum("bet_p").alias("plain"), F.sum(F.col("w") * F.col("bet_p")).alias("weighed"),
    )
    equal = checkpointed(equal, collect=True)
    some = F.col("weight_sum") > 0
    one = F.sum(F.when(F.col("several").isNull(), F.col("rubrics")).otherwise(0))
    means = equal.groupBy(*keys).agg(F.sum("nw").alias("weight_sum"), F.sum("n").alias("_n"), F.sum("plain").alias("_plain"), F.sum("weighed").alias("_weighed"), (one + F.countDistinct("several")).alias("rubrics"))
    means = means.select(*keys, F.when(some, F.col("_weighed") / F.col("weight_sum")).otherwise(F.col("_plain") / F.col("_n")).alias("mean"), "rubrics", F.when(some, F.col("weight_sum")).otherwise(F.col("_n").cast("double")).alias("weight_sum"))
    points = equal.groupBy(*keys, "v").agg(F.sum("n").alias("n"), F.sum("nw").alias("nw"), F.min("w").alias("w"))
    total = points.groupBy(*keys).agg((F.sum("nw") > 0).alias("_some"))
    points = joined(points, total, keys).withColumns({"nw": F.when(F.col("_some"), F.col("nw")).otherwise(F.col("n").cast("double")), "w": F.when(F.col("_some"), F.col("w")).otherwise(1.0)}).drop("_some")
    return joined(means, _quantiles(points, keys, (0.1, 0.9)), keys, "left")


def _even(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x + EPSILON)
    return F.transform(p, lambda x: (x + EPSILON) / total)


def _relative(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(_even(p), _even(q), lambda x, y: x * F.log(x / y)), F.lit(0.0), lambda a, x: a + x)


def divergences(bet: DataFrame) -> DataFrame:
    """``sample_ordinal, left_tag, right_tag, js, tv`` of every two experiments of one scale that share the sample.

    A sample has a row an experiment, so pairs are as many as the square of the experiments, not of the data.
    """
    p = bet.groupBy(*SAMPLE).agg(F.transform(F.sort_array(F.collect_list(F.struct("stage", "bet_p"))), lambda s: s["bet_p"]).alias("p"))
    a, b = (p.select("sample_ordinal", F.size("p").alias("scale"), F.col("experiment_tag").alias(f"{s}_tag"), F.col("p").alias(s)) for s in ("left", "right"))
    rows = a.join(b, ["sample_ordinal", "scale"]).where("left_tag < right_tag")
    rows = rows.withColumn("left", _even(F.col("left"))).withColumn("right", _even(F.col("right"))).withColumn("middle", F.zip_with("left", "right", lambda x, y: (x + y) / 2))
    tv = F.aggregate(F.zip_with("left", "right", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: m + x) / 2
    js = (_relative(F.col("left"), F.col("middle")) + _relative(F.col("right"), F.col("middle"))) / 2
    return rows.select("sample_ordinal", "left_tag", "right_tag", js.alias("js"), tv.alias("tv"))


def divergence_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("left_tag", "right_tag").agg(F.count("*").alias("n"), F.avg("js").alias("mean_js"), F.percentile("js", F.lit(0.5)).alias("median_js"), F.avg("tv").alias("mean_tv"), F.percentile("tv", F.lit(0.5)).alias("median_tv"))


def largest_divergences(rows: DataFrame, top: int = 3) -> DataFrame:
    by = Window.partitionBy("left_tag", "right_tag").orderBy(F.desc(F.round("js", 9)), "sample_ordinal")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top)


def z_scores(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``z``, the value's distance from its key's mean in population deviations; 0 if they don't differ."""
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    return rows.withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(by), F.stddev_pop(value).over(by)), F.when(F.col(value).isNotNull(), 0.0)))


def outliers(metrics: DataFrame, columns: list[str], low_only: bool = False) -> DataFrame:
    """``experiment_tag, metric, value, z`` of the experiments that stand out on a metric, on either side or only below."""
    long = metrics.select("experiment_tag", F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value"))
    z = z_scores(long.where("value is not null"), ["metric"], "value")
    return z.where(F.col("z") <= -OUTLYING if low_only else F.abs("z") >= OUTLYING)


def candidate_findings(effects: DataFrame, metrics: DataFrame, shapes: DataFrame, instability: DataFrame, certainty: DataFrame) -> DataFrame:
    """``finding_kind, subject, detail, score`` from five tables: the largest 12 effects, all outliers, 10 unstable samples, 4 shifts of certainty."""
    largest = lambda df, n, *ties: df.orderBy(F.desc(F.round("score", 9)), *ties).limit(n)
    kind = lambda df, name, subject, detail: df.select(F.lit(name).alias("finding_kind"), F.col(subject).cast("string").alias("subject"), detail.alias("detail"), "score")
    effects = largest(effects.withColumn("score", F.abs("mean_delta")), 12, "contrast_id", "endpoint")
    certainty = largest(certainty.where("endpoint = 'mean_agreement'").withColumn("score", F.abs("mean_delta")), 4, "contrast_id")
    instability = largest(instability.withColumn("score", F.col("instability")), 10, "sample_ordinal").withColumn("subject", F.concat(F.lit("S"), F.when(F.col("sample_ordinal") < 10, "0").otherwise(""), F.col("sample_ordinal").cast("string")))
    both = ["abstain_rate", "singleton_rate", "mean_subset_size", "mean_tbm_conflict", "mean_closed_world_conflict"]
    parts = [
        kind(effects, "family_effect", "contrast_id", F.col("endpoint")), kind(outliers(metrics, both).withColumn("score", F.abs("z")), "experiment_outlier", "experiment_tag", F.col("metric")),
        kind(outliers(shapes, ["mid_scale_mass", "stage_entropy"], low_only=True).withColumn("score", F.abs("z")), "compression_outlier", "experiment_tag", F.col("metric")),
        kind(instability, "sample_instability", "subject", F.lit("instability")), kind(certainty, "scale_certainty", "contrast_id", F.col("endpoint")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def descriptive_findings(candidates: DataFrame, top: int = 25) -> DataFrame:
    """Candidates that no test stands behind, by size."""
    return candidates.where("finding_kind <> 'family_effect'").withColumn("rank_score", F.abs("score")).orderBy(F.desc(F.round("rank_score", 9)), "finding_kind", "subject", "detail").limit(top)


def merged_findings(descriptive: DataFrame, inferential: DataFrame) -> DataFrame:
    """Both rankings as one, with its ``place``: by scope, then by falling score, equal scores by name. A ranking has a few rows."""
    d = descriptive.select(F.lit("descriptive").alias("finding_scope"), F.concat_ws(":", F.lit("descriptive"), "finding_kind", "subject").alias("finding_id"), "rank_score", F.col("detail"))
    i = inferential.select(F.lit("inferential").alias("finding_scope"), F.concat_ws(":", F.lit("inferential"), "contrast_id", "endpoint").alias("finding_id"), "rank_score", F.lit("").alias("detail"))
    order = Window.orderBy("finding_scope", F.desc(F.round("rank_score", 9)), "finding_id", "detail")
    return i.unionByName(d).withColumn("place", F.row_number().over(order)).drop("detail")


def report_panel(summary: DataFrame, alignment: DataFrame) -> DataFrame:
    """Per method: responses and means of its means over the experiments, and how far it is from the reference method."""
    by = summary.groupBy("method").agg(F.sum("n").alias("n"), F.avg("mean_expected_stage").alias("mean_expected_stage"), F.avg("mean_top_p").alias("mean_top_p"))
    return by.join(alignment.groupBy("method").agg(F.avg("mean_absolute").alias("mean_absolute"), F.avg("bias").alias("bias")), "method", "left")


def profiles_with_totals(profiles: DataFrame, bundles: DataFrame) -> DataFrame:
    """Verdict profiles beside what is known of their bundles; a missing bundle number matches a missing one."""
    p, b = profiles.alias("p"), bundles.alias("b")
    same = F.col("p.experiment_tag").eqNullSafe(F.col("b.experiment_tag")) & F.col("p.bundle_no").eqNullSafe(F.col("b.bundle_no"))
    return p.join(b, same, "left").select("p.*", F.col("b.n").alias("bundle_n"), F.col("b.abstain_rate").alias("bundle_abstain_rate"))


def verdict_order(certainty: DataFrame) -> DataFrame:
    """Verdicts of each experiment in the order of a legend: by size, first stage and text, abstentions last."""
    stages = F.transform(F.regexp_extract_all("verdict", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    key = [F.col("verdict") == "ABSTAIN", F.size(stages), F.array_min(stages), F.col("verdict")]
    return certainty.withColumn("place", F.row_number().over(Window.partitionBy("experiment_tag").orderBy(*key)))


def label_pages(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with the page and the place on it, pages of ``size`` within a key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("page", F.floor(at / size) + 1).withColumn("slot", at % size + 1)


def length_bias(responses: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of responses with a verdict and stages: whether the stage was ``selected``, and its text's length in deviations within its rubric.

    ``words`` has ``bundle_no, stage, words``. A rubric's stages of one length have 0; a stage without a text has a null. Abstentions
    choose between no stages and stay out.
    """
    z = z_scores(words, ["bundle_no"], "words").select("bundle_no", "stage", F.col("z").alias("length_z"))
    rows = responses.where("mask <> 0").select("experiment_tag", "bundle_no", "mask", "obs", "disc", F.explode(F.sequence(F.lit(1), F.col("scale_size").cast("int"))).alias("stage"))
    chosen = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("stage") - 1)) != 0
    return rows.select("experiment_tag", "bundle_no", "stage", "obs", "disc", chosen.cast("double").alias("selected")).join(z, ["bundle_no", "stage"], "left")


def length_slopes(rows: DataFrame) -> DataFrame:
    """Per experiment with at least ten rows and stages both chosen and not: how choice depends on length, and the p-value."""
    enough = rows.groupBy("experiment_tag").agg(F.count("*").alias("n_rows"), F.countDistinct("selected").alias("kinds")).where("n_rows >= 10 and kinds > 1")
    return least_squares(rows, "experiment_tag", "selected", ["length_z"]).join(enough, "experiment_tag").select("experiment_tag", F.col("coef").alias("coef_stage_len_z"), "p_value", "n_rows")


def pair_cosine(vectors: DataFrame, contrasts: DataFrame) -> DataFrame:
    """``contrast_id, sample_ordinal, cosine`` of the arms' vectors on shared samples, and their mean as sample -1."""
    arm = lambda side: vectors.select(F.col("experiment_tag").alias(f"{side}_tag"), "sample_ordinal", F.col("vector").alias(side))
    rows = contrasts.select("contrast_id", "baseline_tag", "variant_tag").join(arm("baseline"), "baseline_tag").join(arm("variant"), ["variant_tag", "sample_ordinal"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda m, x: m + x)
    rows = rows.select("contrast_id", F.col("sample_ordinal").cast("long").alias("sample_ordinal"), F.try_divide(dot("baseline", "variant"), F.sqrt(dot("baseline", "baseline") * dot("variant", "variant"))).alias("cosine"))
    return rows.unionByName(rows.groupBy("contrast_id").agg(F.lit(-1).cast("long").alias("sample_ordinal"), F.avg("cosine").alias("cosine")))


def responses_by_shape(responses: DataFrame) -> DataFrame:
    return responses.select("response_id", "experiment_tag", label(F.col("mask"), F.col("scale_size")).alias("verdict"), bucket(F.col("mask"), F.col("scale_size")).alias("bucket"))


def focus_label(tag: Column, model: Column, view: Column) -> Column:
    """Family, short model name and, if the tag or the view has one, a mark, with bars between them."""
    marks = (F.when(tag.contains(held), mark) for held, mark in MARKS)
    return F.concat_ws("|", family(tag), model, F.coalesce(*marks, F.when(view == ABSTRACTED[0], ABSTRACTED[1])))


def focus_similarity(similarity: DataFrame, experiments: DataFrame, models: list[str]) -> DataFrame:
    """Rows of ``similarity`` (``experiment_a, experiment_b``) whose both experiments are by one of ``models``, with what is known of each.

    ``experiments`` has ``experiment_tag, model_id, model_short, evidence_view``, one row a tag.
    """
    tag = F.col("experiment_tag")
    focus = experiments.where(F.col("model_id").isin(models))
    known = focus.select(tag, F.col("model_id").alias("model"), family_slug(tag).alias("family"), focus_label(tag, F.col("model_short"), F.col("evidence_view")).alias("display_label"))
    for side in ("a", "b"):
        mine = known.select(tag.alias(f"experiment_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("model", "family", "display_label")))
        similarity = similarity.join(mine, f"experiment_{side}")
    return similarity


def method_order(rows: DataFrame, order: tuple[str, ...], column: str = "method") -> DataFrame:
    """``rows`` with the ``place`` of a value in a declared order, as methods and statuses are sorted; null for others, which come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.withColumn("place", F.when(at > 0, at.cast("int")))


def tag_order(experiments: DataFrame) -> DataFrame:
    """Experiments with their ``place`` by model, scale, bundle size and tag. Experiments are few."""
    return experiments.withColumn("place", F.row_number().over(Window.orderBy("model_id", "scale_size", "bundle_size", "experiment_tag")))


def comparison_groups(experiments: DataFrame) -> DataFrame:
    """Experiments by scale and bundle size, missing ones as 0: the number of their group, and their ``place`` in it by family, model and tag."""
    known = experiments.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("scale_size", "bundle_size")}).withColumn("family_slug", family_slug(F.col("experiment_tag")))
    group = ["scale_size", "bundle_size"]
    return known.withColumn("group_no", F.dense_rank().over(Window.orderBy(*group))).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("family_slug", "model_id", "experiment_tag")))
