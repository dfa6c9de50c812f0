"""What models are shown: evidence, rubrics and their labels as text; and identities of texts, plans, tags and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offset and prime of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


#: Letters of opaque labels and their number; the factors of a label's seed, and what a further attempt adds to it.
ALPHABET, LABEL_LENGTH = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 6
OF_SEED, OF_STAGE, OF_ATTEMPT = 2654435761, 2246822519, 1000003
ATTEMPTS = 3
_M = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 units, as eight hexadecimal digits after its name."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    high = lambda p: F.floor((p - 65536) / 1024).cast("long") + 55296
    units = F.flatten(F.transform(points, lambda p: F.when(p > 65535, F.array(high(p), (p - 65536) % 1024 + 56320)).otherwise(F.array(p))))
    value = F.aggregate(units, F.lit(FNV_OFFSET).cast("long"), lambda h, u: h.bitwiseXOR(u) * FNV_PRIME % (1 << 32))
    return F.concat(F.lit("fnv1a:"), F.lower(F.lpad(F.hex(value), 8, "0")))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_M))


def _times(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of two 32-bit numbers, in halves, as a long would overflow."""
    return _low(F.shiftleft(_low(F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b)


def drawn(seed: Column, step: Column) -> Column:
    """The ``step``-th number, from 1, of the generator behind seeded orders: 32 bits, a function of seed and step alone."""
    let = lambda x, f: F.transform(F.array(x), f)[0]
    state = _low(seed.cast("long") + _low(step.cast("long") * 0x6D2B79F5))
    first = lambda s: _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    second = lambda t: _low(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseXOR(t)
    return let(let(let(state, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14)))


def below(draw: Column, n: Column) -> Column:
    """A whole number from 0 on and below n for a draw."""
    return F.shiftright(draw * n.cast("long"), 32)


def _label(seed: Column, stage: Column) -> Column:
    own = F.transform(F.array(_times(_low(seed), F.lit(OF_SEED)).bitwiseXOR(_times(_low(stage), F.lit(OF_STAGE)))), lambda s: F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(LABEL_LENGTH)), lambda k: F.substring(F.lit(ALPHABET), (below(drawn(s, k), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))), ""))
    return own[0]


def opaque_labels(seed: Column, stages: Column) -> Column:
    """A label of six letters and digits for each of so many stages, different ones; a label that is taken is drawn anew."""

    def free(taken: Column, stage: Column, attempt: int) -> Column:
        own = _label(seed.cast("long") + attempt * OF_ATTEMPT, stage.cast("long"))
        if attempt == ATTEMPTS - 1:
            return own
        return F.transform(F.array(own), lambda t: F.when(~F.array_contains(taken, t), t).otherwise(free(taken, stage, attempt + 1)))[0]

    return F.aggregate(F.sequence(F.lit(1), stages.cast("int")), F.array().cast("array<string>"), lambda taken, stage: F.concat(taken, F.array(free(taken, stage, 0))))


def letters(stages: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), stages.cast("int")), lambda s: F.char(s + 64))


def label_mapping(seed: Column, stages: Column, opaque: Column) -> Column:
    """A map from each stage's label, opaque or its letter, to the stage's number."""
    return F.map_from_arrays(F.when(opaque, opaque_labels(seed, stages)).otherwise(letters(stages)), F.sequence(F.lit(1), stages.cast("int")))


def tokens_of(mapping: Column, stages: Column) -> Column:
    """The labels of a mapping in the order of their stages; a stage without one has its letter."""
    entries = F.map_entries(mapping)
    return F.transform(F.sequence(F.lit(1), stages.cast("int")), lambda s: F.coalesce(F.get(F.filter(entries, lambda e: e["value"] == s), F.lit(0))["key"], F.char(s + 64)))


def seeded_order(items: Column, seed: Column) -> Column:
    """The items of an array in the order that the seed gives them; as they are if it is null."""

    def swap(out: Column, i: Column) -> Column:
        j = below(drawn(seed, F.size(items) - i + 1), i) + 1
        return F.transform(F.array(j), lambda j: F.transform(out, lambda x, k: F.when(k + 1 == i, F.get(out, (j - 1).cast("int"))).when(k + 1 == j, F.get(out, i - 1)).otherwise(x)))[0]

    steps = F.when(F.size(items) > 1, F.sequence(F.size(items), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.when(seed.isNull(), items).otherwise(F.aggregate(steps, items, swap))


def rendered_evidence(items: DataFrame, key: str, position: str, levels: list[str]) -> DataFrame:
    """Each bundle's evidence as one text for each level, in order: a numbered heading and the text below it.

    A missing text is that of the level before it; without any it is empty. Levels are given from the raw one on.
    """
    at_level = lambda i: F.coalesce(*(F.col(c) for c in reversed(levels[: i + 1])), F.lit(""))
    section = F.struct(F.col(position).alias("at"), *(at_level(i).alias(c) for i, c in enumerate(levels)))
    rows = items.groupBy(key).agg(F.sort_array(F.collect_list(section)).alias("s"))  # a bundle's evidence
    text = lambda c: F.array_join(F.transform("s", lambda s, i: F.concat(F.lit("EVIDENCE "), (i + 1).cast("string"), F.lit("\n"), s[c])), "\n\n")
    return rows.select(key, *(text(c).alias(c) for c in levels))


def displayed_rubric(stages: Column, tokens: Column, seed: Column | None = None, hide_labels: bool = False) -> Column:
    """A rubric's lines, each stage behind its token, in the seed's order if there is one; the stages' own labels may be hidden."""
    name = lambda s: F.lit("") if hide_labels else F.concat(F.lit('"'), s["label"], F.lit('" - '))
    lines = F.transform(stages, lambda s, i: F.concat(F.coalesce(F.get(tokens, i), F.char(i + 65)), F.lit(": "), name(s), F.lit("Criteria: "), F.array_join(s["criteria"], "; ")))
    return lines if seed is None else seeded_order(lines, seed)


def verdict_summary(stages: Column, tokens: Column) -> Column:
    """A verdict for its critic: ``status``, and the tokens of the valid stages, each once and in order."""
    valid = F.array_sort(F.array_distinct(F.filter(F.coalesce(stages, F.array().cast("array<int>")), lambda s: (s >= 1) & (s <= F.size(tokens)))))
    return F.struct(F.when(F.size(valid) > 0, "scored").otherwise("abstain").alias("status"), F.transform(valid, lambda s: F.get(tokens, (s - 1).cast("int"))).alias("selected_identifiers"))


def display_labels(experiments: DataFrame) -> DataFrame:
    """``experiment_tag, display_label``: the model, or the tag where several experiments share the model."""
    shared = F.count("*").over(Window.partitionBy("model_id")) > 1
    return experiments.select("experiment_tag", F.when(shared, F.col("experiment_tag")).otherwise(F.col("model_id")).alias("display_label"))


def cohort(tags: DataFrame, wanted: list[str] | None = None, prefix: str = "v3_") -> DataFrame:
    """``tag, present``: the tags of a cohort; of those asked for by name also the missing ones."""
    if wanted is None:
        return tags.select("tag").distinct().where(F.col("tag").startswith(prefix)).withColumn("present", F.lit(True))
    asked = tags.sparkSession.createDataFrame([(t,) for t in wanted], "tag string").distinct()
    return asked.join(tags.select("tag").distinct().withColumn("here", F.lit(True)), "tag", "left").select("tag", F.coalesce("here", F.lit(False)).alias("present"))


def set_problems(contract: DataFrame, bundle: DataFrame, column: str) -> DataFrame:
    """``problem, value``: what a contract names and a bundle lacks, what the bundle has besides, and what the contract repeats."""
    a, b = contract.select(column), bundle.select(column).distinct()
    tell = lambda df, name: df.select(F.lit(name).alias("problem"), F.col(column).alias("value"))
    repeated = a.groupBy(column).count().where("count > 1")
    return tell(a.distinct().join(b, column, "left_anti"), "missing").unionByName(tell(b.join(a.distinct(), column, "left_anti"), "unexpected")).unionByName(tell(repeated, "repeated"))


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def resolved_prompts(requests: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Requests beside their templates' texts; ``dangling`` where the template is gone."""
    return requests.join(templates.withColumn("_here", F.lit(True)), key, "left").withColumn("dangling", F.col("_here").isNull()).drop("_here")


def pool_windows(links: DataFrame, evidence: DataFrame, pool: str, id: str, window: str) -> DataFrame:
    """The different windows of each pool's evidence, sorted; links to missing evidence say nothing."""
    return links.join(evidence.select(id, window), id).groupBy(pool).agg(F.array_join(F.array_sort(F.collect_set(F.col(window).cast("string"))), "|").alias("windows"), F.countDistinct(id).alias("evidence"))


def same_plans(wanted: DataFrame, plans: DataFrame, columns: list[str]) -> DataFrame:
    """Plans asked for beside the first existing one that is equal in all columns, where a null equals a null; else null."""
    w, p = wanted.alias("w"), plans.groupBy(*columns).agg(F.min("plan_id").alias("plan_id")).alias("p")
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}"))
    return w.join(p, equal, "left").select("w.*", F.col("p.plan_id"))
