"""Queries of what models are shown and of identities, registered with those of ``plans.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.verdicts import stages_of
from assayer.operators import belief, geometry, prompts, text
from assayer.plans.queries import _R, _query, _uniform_sql
from assayer.sources.embeddings import letter_counts
from assayer.sources.fixtures import responses, table


@_query("r6_prompt_hashes", "select p_partkey, 'fnv1a:' || printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name, ''), lambda c: unicode(c)::bigint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)) as hash from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", prompts.fnv1a(F.col("p_name")).alias("hash"))


_EVIDENCE = """select l_orderkey, l_linenumber, p_name as l0, case when p_size % 3 > 0 then p_brand end as l1, case when p_size % 5 = 0 then p_type end as l2, case when p_size % 7 = 0 then l_returnflag end as l3 from {lineitem} join {part} on l_partkey = p_partkey"""
_SECTION = "array_to_string(list_transform(range(1, len(x) + 1), lambda i: concat('EVIDENCE ', i, chr(10), x[i].{0})), chr(10) || chr(10)) as {0}"


@_query("f36_rendered_evidence", f"""with e as ({_EVIDENCE.format(lineitem="lineitem", part="part")}), f as (select l_orderkey, l_linenumber as n, l0, coalesce(l1, l0) as l1, coalesce(l2, l1, l0) as l2, coalesce(l3, l2, l1, l0) as l3 from e)
select l_orderkey, {", ".join(_SECTION.format(f"l{i}") for i in range(4))} from (select l_orderkey, list({{'n': n, 'l0': l0, 'l1': l1, 'l2': l2, 'l3': l3}} order by n, l0, l1, l2, l3) as x from f group by 1)""")
def _(spark, d):
    items = spark.sql(_EVIDENCE, lineitem=table(spark, d, "lineitem"), part=table(spark, d, "part"))
    return prompts.rendered_evidence(items, "l_orderkey", "l_linenumber", ["l0", "l1", "l2", "l3"])


def _product_sql(a: str, b: str) -> str:
    return f"((({a})::hugeint * ({b})) & 4294967295)::bigint"


_IDS = f"""list_transform(range(1, n + 1), lambda i: array_to_string(list_transform(range(1, 7), lambda k: substr('{prompts.ALPHABET}', (floor({_uniform_sql(f"xor({_product_sql('seed & 4294967295', str(prompts.OF_SEED))}, {_product_sql('i', str(prompts.OF_STAGE))})", "k")} * 62) + 1)::int, 1)), ''))"""


@_query("r4_r5_label_mappings", f"""with s as (select o_orderkey, (o_orderkey * 7919 - 100000)::bigint as seed, (o_orderkey % 6 + 3)::int as n, o_orderkey % 4 > 0 as opaque from orders), t as (select *, case when opaque then {_IDS} else list_transform(range(1, n + 1), lambda i: chr((i + 64)::int)) end as ids from s)
select o_orderkey, array_to_string(list_transform(range(1, n + 1), lambda i: concat(ids[i], '=', i)), ' ') as mapping from t""")
def _(spark, d):
    k = F.col("o_orderkey")
    n = (k % 6 + 3).cast("int")
    mapping = prompts.label_mapping((k * 7919 - 100000).cast("long"), n, k % 4 > 0)
    shown = F.array_join(F.transform(prompts.tokens_of(mapping, n), lambda t, i: F.concat(t, F.lit("="), (i + 1).cast("string"))), " ")
    return table(spark, d, "orders").select(k, shown.alias("mapping"))


_SWAPPED = lambda l, i, j: f"list_transform({l}, lambda x, k: case when k = {i} then {l}[{j}] when k = {j} then {l}[{i}] else x end)"  # noqa: E731, E741
_LINE = "concat(t[{0}], ': \"', {1}, '\" - Criteria: ', {2})"


@_query("f34_displayed_rubrics", f"""with s as (select p_partkey, (p_partkey * 31 + 5)::bigint as seed, 3 as n, p_name, p_brand, p_type from part), t as (select *, {_IDS} as t from s),
l as (select *, [{_LINE.format(1, "p_name", "p_brand || '; ' || p_type")}, {_LINE.format(2, "'middle'", "p_type")}, {_LINE.format(3, "'last'", "'none'")}] as l0, floor({_uniform_sql("seed", "1")} * 3)::bigint + 1 as j3, floor({_uniform_sql("seed", "2")} * 2)::bigint + 1 as j2 from t),
m as (select *, {_SWAPPED("l0", 3, "j3")} as l1 from l), o as (select *, {_SWAPPED("l1", 2, "j2")} as l2 from m)
select p_partkey, array_to_string(l2, chr(10)) as shown, array_to_string(['A: Criteria: ' || p_brand || '; ' || p_type, 'B: Criteria: ' || p_type, 'C: Criteria: none'], chr(10)) as hidden from o""")
def _(spark, d):
    stage = lambda label, *criteria: F.struct(label.alias("label"), F.array(*criteria).alias("criteria"))
    stages = F.array(stage(F.col("p_name"), F.col("p_brand"), F.col("p_type")), stage(F.lit("middle"), F.col("p_type")), stage(F.lit("last"), F.lit("none")))
    seed, n = (F.col("p_partkey") * 31 + 5).cast("long"), F.lit(3)
    part = table(spark, d, "part").withColumn("labels", prompts.label_mapping(seed, n, F.lit(True))).withColumn("tokens", prompts.tokens_of(F.col("labels"), n))
    shown, hidden = prompts.displayed_rubric(stages, F.col("tokens"), seed), prompts.displayed_rubric(stages, prompts.letters(n), hide_labels=True)
    return part.select("p_partkey", F.array_join(shown, "\n").alias("shown"), F.array_join(hidden, "\n").alias("hidden"))


@_query("f35_verdict_summaries", f"{_R}, t as (select response_id, list_transform(list_filter(range(1, scale_size + 1), lambda s: (mask & (1::bigint << (s - 1))) <> 0), lambda s: concat('T', s)) as ids from r) select response_id, case when len(ids) > 0 then 'scored' else 'abstain' end as status, array_to_string(ids, ', ') as selected from t")
def _(spark, d):
    s = stages_of(F.col("mask"), F.col("scale_size"))
    tokens = F.transform(F.sequence(F.lit(1), F.col("scale_size").cast("int")), lambda i: F.concat(F.lit("T"), i.cast("string")))
    summary = prompts.verdict_summary(F.concat(F.reverse(s), s, F.array(F.lit(0), F.lit(99))), tokens)
    return responses(spark, d).select("response_id", summary["status"].alias("status"), F.array_join(summary["selected_identifiers"], ", ").alias("selected"))


@_query("p12_display_labels", "with e as (select distinct concat('v3_a1_', c_nationkey) as experiment_tag, concat('model-', (c_nationkey * c_nationkey) % 11) as model_id from customer) select experiment_tag, case when count(*) over (partition by model_id) > 1 then experiment_tag else model_id end as display_label from e")
def _(spark, d):
    n = F.col("c_nationkey")
    e = table(spark, d, "customer").select(F.concat(F.lit("v3_a1_"), n.cast("string")).alias("experiment_tag"), F.concat(F.lit("model-"), (n * n % 11).cast("string")).alias("model_id")).distinct()
    return prompts.display_labels(e)


@_query("p14_u3_cohort", "select t as tag, t in (select p_brand from part) as present from (select unnest(['Brand#1', 'Brand#2', 'Brand#77', 'none']) as t)")
def _(spark, d):
    return prompts.cohort(table(spark, d, "part").select(F.col("p_brand").alias("tag")), ["Brand#1", "Brand#2", "Brand#77", "none"])


@_query("p28_p29_u4_contract_problems", "with a as (select o_custkey as k from orders), b as (select distinct c_custkey as k from customer where c_nationkey > 3) select 'missing' as problem, k as value from (select distinct k from a) where k not in (select k from b) union all select 'unexpected', k from b where k not in (select k from a) union all select 'repeated', k from a group by k having count(*) > 1")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return prompts.set_problems(a, table(spark, d, "customer").where("c_nationkey > 3").select(F.col("c_custkey").alias("k")), "k")


@_query("j8_j16_resolved_prompts", "select l_orderkey, l_linenumber, l_partkey, p_name, p_partkey is null as dangling from lineitem left join (select * from part where p_size > 10) on l_partkey = p_partkey")
def _(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return prompts.resolved_prompts(r, table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")


@_query("j5_j6_pool_windows", "select l_suppkey, array_to_string(list_sort(list(distinct p_size::varchar)), '|') as windows, count(distinct l_partkey) as evidence from lineitem join part on l_partkey = p_partkey group by 1")
def _(spark, d):
    links = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return prompts.pool_windows(links, table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_suppkey", "l_partkey", "p_size")


@_query("bp6_bp7_same_plans", "with p as (select o_orderpriority as strategy, nullif(o_orderstatus, 'P') as version, o_custkey as seed, min(o_orderkey) as plan_id from orders where o_orderdate < '1995-01-01' group by 1, 2, 3), w as (select o_orderkey, o_orderpriority as strategy, nullif(o_orderstatus, 'P') as version, o_custkey as seed from orders) select w.o_orderkey, w.strategy, w.version, w.seed, plan_id from w left join p on w.strategy = p.strategy and w.version is not distinct from p.version and w.seed = p.seed")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("strategy"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("version"), F.col("o_custkey").alias("seed"), "o_orderdate")
    plans = o.where("o_orderdate < '1995-01-01'").drop("o_orderdate").withColumnRenamed("o_orderkey", "plan_id")
    return prompts.same_plans(o.drop("o_orderdate"), plans, ["strategy", "version", "seed"])


@_query("m16_x1_encoded_texts", """select doc_id, array_to_string(list_transform(range(0, 26), lambda i: (length(text) - length(replace(lower(text), chr((97 + i)::int), '')))::int), ',') as letters from (select doc_id, coalesce(text, '') as text from documents)""")
def _(spark, d):
    """How often each letter occurs in each document, by an encoder that is given."""
    vectors = text.embed(table(spark, d, "documents").select("doc_id", "text"), letter_counts)
    return vectors.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("letters"))


@_query("m_masses", f"""{_R}, x as (select *, unnest(range(0, 1::bigint << scale_size)) as s from r), q as (select experiment_tag, sample_ordinal, s, product(case when s = 0 then 1.0 when mask = 0 then 1 - agreement when mask = (1::bigint << scale_size) - 1 then agreement when (s & ~mask) = 0 then 1.0 else 1 - agreement * obs * disc end) as q from x group by all)
select a.experiment_tag, a.sample_ordinal, a.s as subset, n<sum(case when bit_count(b.s) % 2 = bit_count(a.s) % 2 then b.q else -b.q end)>n as mass from q a join q b on a.experiment_tag = b.experiment_tag and a.sample_ordinal = b.sample_ordinal and (a.s & ~b.s) = 0 group by 1, 2, 3""", nudge=3.7e-13)
def _(spark, d):
    return belief.masses(belief.commonalities(responses(spark, d), geometry.SAMPLE), geometry.SAMPLE)
