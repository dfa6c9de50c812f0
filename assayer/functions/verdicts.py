"""Column functions over verdicts: sets of stages 1..n of an ordinal scale, as bit masks (bit s - 1 is stage s; 0 abstains)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_of(stages: Column, scale: Column) -> Column:
    """The mask of an array of stages; a stage outside 1..scale is an error, null an abstention."""
    bad = F.exists(stages, lambda s: (s < 1) | (s > scale))
    bits = F.aggregate(F.array_distinct(stages), F.lit(0).cast("long"), lambda m, s: m + F.call_function("shiftleft", F.lit(1).cast("long"), (s - 1).cast("int")))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("stage outside the scale"))).otherwise(F.coalesce(bits, F.lit(0).cast("long")))


def stages_of(mask: Column, scale: Column) -> Column:
    """The sorted stages of a mask."""
    return F.filter(F.sequence(F.lit(1), scale.cast("int")), lambda s: has(mask, s))


def has(mask: Column, stage: Column) -> Column:
    return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (stage - 1).cast("int"))) != 0


def full(scale: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), scale.cast("int")) - 1


def expected_stage(mask: Column, scale: Column) -> Column:
    """The mean stage; null for an abstention. Stages are added up by the bits of their numbers, as counts of the mask's bits."""
    inside = F.when(scale < 63, mask.bitwiseAND(full(scale))).otherwise(mask.cast("long"))
    having = lambda j: sum(1 << (s - 1) for s in range(1, 64) if s >> j & 1)
    total = sum((F.bit_count(inside.bitwiseAND(F.lit(having(j)))) * (1 << j) for j in range(6)), F.when(inside < 0, 64).otherwise(0))
    return F.try_divide(total.cast("double"), F.bit_count(mask).cast("double"))


def label(mask: Column, scale: Column) -> Column:
    """``ABSTAIN``, or the stages as in ``[1,3]``."""
    return F.when(mask == 0, "ABSTAIN").otherwise(F.concat(F.lit("["), F.array_join(stages_of(mask, scale).cast("array<string>"), ","), F.lit("]")))


def bucket(mask: Column, scale: Column) -> Column:
    """The shape of a verdict: abstain, singleton, adjacent, non-adjacent, or broad from three stages on."""
    s, size = stages_of(mask, scale), F.bit_count(mask)
    return (
        F.when(size == 0, "abstain").when(size == 1, "singleton").when(size >= 3, "broad_subset")
        .when(F.array_max(s) - F.array_min(s) == 1, "adjacent_subset").otherwise("non_adjacent_subset")
    )


def clamp(x: Column, default: float = 1.0) -> Column:
    """Into 0..1; null and not-a-number as the default."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(default))))


def rounded(x: Column, digits: int = 9, nudge: float = 0.0) -> Column:
    """Rounded, halves away from 0, and never -0, as DuckDB does it: in doubles, so that two engines agree on ties too; a nudge keeps products of
    short decimals off them."""
    x = x.cast("double") + nudge
    y = F.abs(x) * 10.0**digits
    whole = F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(x) < 1e15, F.signum(x) * (whole / 10.0**digits)).otherwise(x) + 0.0


#: What the family codes of tags stand for.
FAMILIES = {
    "a1": "abstain_toggle", "a2": "evidence_level_l3", "a3": "scale_size", "a4": "model_swap", "a5": "concept_swap", "a6": "bundle_5_l2", "a7": "bundle_5_l3",
    "b1": "small_model_family", "c1": "bundle_5_random_l2", "c2": "bundle_5_cluster_l2_v2", "c3": "bundle_5_cluster_l3_v2", "c4": "small_model_scale_5",
    "c5": "small_model_bundle_5_cluster_l2", "c6": "bundle_5_cluster_l2_scale_7",
}


def family(tag: Column) -> Column:
    """The family code of a tag such as ``v3_a1_alpha`` or ``v3_1_a1_alpha``; ``misc`` without one."""
    parts = F.split(tag, "_")
    minor = tag.startswith("v3_1_")
    return F.coalesce(F.when(minor, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))), F.lit("misc"))


def family_slug(tag: Column) -> Column:
    names = F.create_map(*(F.lit(x) for item in FAMILIES.items() for x in item))
    return F.concat_ws("_", family(tag), F.coalesce(F.try_element_at(names, family(tag)), family(tag)))


def variant(tag: Column) -> Column:
    """What follows the family code; the tag itself if nothing does."""
    parts = F.split(tag, "_")
    at = F.when(tag.startswith("v3_1_") & (F.size(parts) > 3), 4).otherwise(3)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, at, F.size(parts)), "_")).otherwise(tag)


def bucket_of_label(label: Column) -> Column:
    """The shape of a verdict's label such as ``[1,3]``; a label without numbers abstains."""
    s = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(label, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))
    size = F.size(s)
    return (
        F.when(label.isNull() | (size == 0), "abstain").when(size == 1, "singleton").when(size >= 3, "broad_subset")
        .when(F.array_max(s) - F.array_min(s) == 1, "adjacent_subset").otherwise("non_adjacent_subset")
    )


def direction(x: Column) -> Column:
    return F.when(x > 0, "positive").when(x < 0, "negative").otherwise("neutral")
