"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.ann import nearest
from assayer.llm.decontamination import contamination
from assayer.llm.html_text import main_text
from assayer.llm.language_id import fit_languages, identify
from assayer.llm.line_dedup import remove_repeated_lines
from assayer.llm.lm_scoring import fit, score
from assayer.llm.near_dedup import near_duplicates
from assayer.llm.packing import pack
from assayer.llm.prefix_trie import ordered, trie
from assayer.llm.quality import fit_quality, score_quality
from assayer.llm.ranked_search import ranked_search
from assayer.llm.scratch import written
from assayer.llm.sharding import shuffle_into_shards
from assayer.llm.substring_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(kept, 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", _held_out())
    model = fit_languages(docs.where("not held_out"))
    return identify(docs, model, keep=["doc_id", "held_out"])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out())
    model = fit_quality(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie after each conversation's first h turns were replaced by those of the conversation at the multiple of 5 below it."""
    turns = written(ordered(table(spark, sf_dir, "conversations")), "turns")
    h, base = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, base)
    given = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = written(convs.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "conversations")
    first = turns.where("place < 9").withColumnRenamed("conv_id", "base")
    front = convs.where("taken > 0").join(first, "base").where("place < taken").select("conv_id", "place", "turn_key", "n_bytes")
    back = turns.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_key", "n_bytes")
    rebuilt = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return trie(written(front.unionByName(back), "rebuilt"), rebuilt)


QUERIES = {f.__name__: f for f in (op1_ann, op2_decontamination, op3_html_text, op4_lm_scoring, op5_line_dedup, op6_packing, op7_substring_dedup, op8_language_id, op9_near_dedup, op10_sharding, op11_quality, op12_ranked_search, op13_prefix_trie)}

_SPACED = r"[\x20\x09-\x0D]+"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERED}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERED}') as w from benchmark),
bl as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
grams as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from bl)),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bl) where len(w) >= n),
found as (select p.doc_id, p.i, p.n, g.item from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from places) p join grams g on g.n = p.n and g.g = p.g),
hits as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from found where item is not null) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)""",
    "op5_line_dedup": f"""
with cut as (select doc_id, string_split(text, chr(10)) as parts from documents),
l as (select doc_id, i, parts[i] as line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(parts[i]), '{_SPACED}'), lambda x: x <> ''))) as w
      from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from cut)),
c as (select w, len(w) as n, min({{'d': doc_id, 'i': i}}) as f from l where len(w) > 0 group by w),
t as (select f, n, unnest(w) as t from c),
r as (select f, n, t, row_number() over (partition by f order by freq, t) as pos from (select *, count(*) over (partition by t) as freq from t)),
p as (select f, n, t from r where pos <= n - (4 * n + 4) // 5 + 1),
pairs as (select distinct a.f as fa, b.f as fb from p a join p b on a.t = b.t and a.f < b.f and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links as (select fa, fb from (select fa, fb, x.n as na, y.n as nb, len(list_intersect(x.w, y.w)) as s from pairs join c x on x.f = fa join c y on y.f = fb) where 5 * s >= 4 * (na + nb - s)),
deg as (select f, count(*) as n, max(later) as later from (select fa as f, 0 as later from links union all select fb, 1 from links) group by f),
marks as (select l.doc_id, l.i, l.line, len(l.w) as nw, c.f is not null as first, coalesce(deg.n, 0) as n_links, coalesce(later, 0) as later
          from l left join c on c.f = {{'d': l.doc_id, 'i': l.i}} left join deg on deg.f = c.f),
per as (select doc_id, count(*) filter (nw > 0) as n_lines, count(*) filter (nw > 0 and not (first and later = 0)) as n_removed, sum(n_links) as n_links,
               string_agg(line, chr(10) order by i) filter (nw = 0 or (first and later = 0)) as kept from marks group by doc_id)
select doc_id, cast(coalesce(n_lines, 0) as int) as n_lines, cast(coalesce(n_removed, 0) as int) as n_removed, cast(coalesce(n_links, 0) as bigint) as n_links, sha256(coalesce(kept, '')) as kept_sha256
from documents left join per using (doc_id)""",
    "op12_ranked_search": f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERED}') as w from documents),
p as (select r, doc_id, len(w) as n, unnest(w) as t from d where len(w) > 0),
g as (select count(distinct r) as n, count(*) as l from p),
c as (select r, doc_id, n, t, count(*) as tf from p group by all),
b as (select row_number() over () as i, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERED}') as w from benchmark),
q as (select i, item_id, t, count(*) as k from (select i, item_id, unnest(w) as t from b) group by all),
f as (select t, floor(1000 * ln((2.0::double * g.n + 2) / (2 * count(*) + 1)))::bigint as w from c, g where t in (select t from q) group by t, g.n),
s as (select i, item_id, r, doc_id, sum(k * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * c.n * g.n) // g.l))))::bigint as score from q join f using (t) join c using (t), g group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""",
    "op13_prefix_trie": """
with t as (select conv_id, sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k, strlen(coalesce(text, '')) as b,
  row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as p from conversations where conv_id is not null),
crc0 as (select i as x, i as c, 0 as step from range(256) r(i)),
crct as (with recursive z as (select * from crc0 union all select x, case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, step + 1 from z where step < 8) select x, c from z where step = 8),
crc as (with recursive y as (select conv_id, conv_id::varchar as s, 4294967295::bigint as c, 1 as i from (select distinct conv_id from t)
  union all select y.conv_id, s, xor(crct.c, y.c >> 8), i + 1 from y join crct on crct.x = xor(y.c, ascii(substr(s, i, 1))::bigint) & 255 where i <= length(s)) select conv_id, xor(c, 4294967295) % 9 as h from y where i = length(s) + 1),
n as (select conv_id, count(*) as n from t group by 1),
v as (select crc.conv_id, h, n.n, conv_id - conv_id % 5 as base, least(h, coalesce(g.n, 0)) as taken from crc join n using (conv_id) left join (select conv_id as gid, n from n) g on g.gid = conv_id - conv_id % 5),
u as (select v.conv_id, p, k, b from v join t on t.conv_id = v.base where p < taken union all select conv_id, p - h + taken, k, b from t join v using (conv_id) where p >= h),
lists as (select v.conv_id, coalesce(l, []) as l, coalesce(bs, []) as bs from v left join (select conv_id, list(k order by p) as l, list(b order by p) as bs from u group by 1) using (conv_id)),
pre as (select conv_id as c, d, l[1:d] as q, len(l) as n, case when d > 0 then bs[d] else 0 end as b from (select *, unnest(range(0, len(l) + 1)) as d from lists)),
r as (select c, d, n, b, min(c) over (partition by d, q) as name from pre),
nodes as (select d, name, count(*) as n_convs, max(b) as b, string_agg(c::varchar, ',' order by c) filter (n = d) as ends from r group by 1, 2),
par as (select x.d, x.name, y.name as parent from nodes x left join r y on y.c = x.name and y.d = x.d - 1),
kids as (select d - 1 as d, parent as name, count(*) as n_children from par where parent is not null group by 1, 2),
sub as (select r.d, r.name, sum((u.n_convs - 1) * u.b) as saved, count(*) filter (k.name is null) as leaves from nodes u join r on r.c = u.name and r.d <= u.d left join kids k on k.d = u.d and k.name = u.name group by 1, 2)
select nodes.name as conv_id, nodes.d as depth, parent as parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from nodes join par using (d, name) left join kids using (d, name) join sub using (d, name)""",
}
