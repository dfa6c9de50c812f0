"""Near-equal lines of documents, by an exact set-similarity join, and documents without the later ones.

A line is the set of its lower-cased words. Lines of one set form a class, whose first line in reading order stands for it.
Two classes are linked if their sets' Jaccard similarity is ``percent`` % or more. The join finds all links:

- a set's words are put in one global order, rarest first; two linked sets share a word among the first n - ceil(t n) + 1
  (the prefix filter), so only prefixes are indexed and probed;
- a prefix word that occurs often is no key by itself: linked sets whose first shared word is such a one share a second word
  in the prefix longer by one, so the two together are the key, whose list is far shorter. Sets of over ``PAIRED`` words,
  whose prefix has too many pairs, are keyed by single words, and so are sets that can be linked with those;
- a pair is dropped where sizes differ too much (length filter), where too few words follow the shared ones (positional
  filter), or where 128-bit odd sketches (every word turns one bit over) differ in too many bits;
- what is left is compared on the whole sets.

Where links are only counted, those in a group of near-equal lines are mostly decided by what each line shares with an early
one of the group, its pivot, and are not made (``link_counts``).

Rarity is the count of a word's hash bucket over all lines, on a scale of powers of two: 256 KB, whatever the corpus. A word
is a 57-bit hash, in a key 32 bits of it; a set that is compared with another is cut from its own line again.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.scratch import written

#: Any run of blanks, \t, \v, \f and \r parts words; lines end at \n. The buckets of rarity, and how many of them one row brings.
BUCKETS, ROW = 1 << 18, 1 << 10
#: From this power of two on, a word's count makes it common; sets of up to PAIRED words have pairs of common words as keys.
COMMON, PAIRED = 11, 100
#: Sets of more words have a sketch of 128 bits instead of 64.
SHORT = 48
#: How many early classes of one pair of samples a class is held against before it looks for all its partners; the pairs of a set's four samples.
SALTS, TURN = 8, 0x5A5A5A5A5A5A5A5A
#: Words apart from a pivot that go along with each of them when pairs are looked for.
FEW = 32
SAMPLED = ((0, 1), (2, 3), (0, 2), (1, 3))
REST = ("n", "prefix", "rare", "map0", "map1")


def _cut(line: Column) -> Column:
    """The lower-cased words of a line, with an empty one for each space too many."""
    # Splitting at one character is several times as fast as at a pattern; few lines have other separators.
    other = [line.contains(c) for c in "\t\x0b\f\r"]
    spaced = F.when(functools.reduce(Column.__or__, other), F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)
    return F.split(F.lower(spaced), " ")


def _words(line: Column) -> Column:
    return F.array_remove(_cut(line), "")


def _blank(line: Column) -> Column:
    """No word in a line; unlike a pattern, it looks at the line's ends only."""
    return F.trim(line, F.lit(" \t\x0b\f\r")) == ""


def rarity(docs: DataFrame) -> bytes:
    """For each hash bucket the power of two of its words' count, in one byte of 1 to 64.

    The empty word is counted as well, and \\v and \\f, which hardly occur, part none: the order of words may be any.
    """
    text = functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\n\t\r", F.col("text"))
    counts = (
        docs.select(F.explode(F.split(F.lower(text), " ")).alias("w"))
        .groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select(F.floor(F.col("bucket") / ROW).cast("int").alias("row"), F.struct((F.col("bucket") % ROW).alias("at"), F.least(F.floor(F.log2("n")) + 1, F.lit(64)).cast("int").alias("power")).alias("one"))
    )
    # A row of buckets as a text: before each power as many 1s as there are empty buckets.
    rows = counts.groupBy("row").agg(F.sort_array(F.collect_list("one")).alias("all"))
    gap = lambda x, i: x["at"] - F.when(i > 0, F.get("all", i - 1)["at"]).otherwise(-1) - 1
    text = F.array_join(F.transform("all", lambda x, i: F.concat(F.repeat(F.lit("\x01"), gap(x, i)), F.char(x["power"]))), "")
    scale = bytearray(b"\x01" * BUCKETS)
    for r in rows.select("row", text.alias("text")).collect():  # BUCKETS / ROW rows at most
        powers = r["text"].encode("ascii")
        scale[r["row"] * ROW : r["row"] * ROW + len(powers)] = powers
    return bytes(scale)


def _hashes(line: Column) -> Column:
    """The 64-bit hashes of the line's set of words."""
    return F.array_remove(F.array_distinct(F.transform(_cut(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _tokens(hashes: Column, scale: Column) -> Column:
    """The set of words as sorted longs: rarity in the upper bits, then the hash."""

    def token(h: Column) -> Column:
        # Never null, so that arrays are sorted as plain longs.
        power = F.coalesce(F.get(scale, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(1).cast("long"))
        return F.shiftleft(power, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    return F.sort_array(F.transform(hashes, token))


def _map(tokens: Column, part: int) -> Column:
    """One of two longs of a set's odd sketch: every word turns one bit over. Of a set of up to SHORT words the first is that of a larger set's two together."""

    def turn(m: Column, t: Column) -> Column:
        return m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))

    none = F.lit(0).cast("long")
    mine = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)) == part
    half = F.aggregate(tokens, none, lambda m, t: F.when(mine(t), turn(m, t)).otherwise(m))
    return F.when(F.size(tokens) > SHORT, half).otherwise(none if part else F.aggregate(tokens, none, turn))


def _apart() -> Column:
    """Bits in which the sketches of two sets differ: no more than words that only one of them has, as shared words turn the same bits."""
    zero, one = (F.col(f"map{i}_a").bitwiseXOR(F.col(f"map{i}_b")) for i in (0, 1))
    return F.when(F.least("n_a", "n_b") > SHORT, F.bit_count(zero) + F.bit_count(one)).otherwise(F.bit_count(zero.bitwiseXOR(one)))


def _prefix(n: Column, percent: int) -> Column:
    """Words of the prefix of a set of n: one more than can be missing in a set that it is linked with."""
    return n - F.floor((F.lit(percent) * n + 99) / 100).cast("int") + 1


def _keys(prefix: Column, rare: Column, n: Column, percent: int, before: Column | None = None) -> Column:
    """The keys of a set, each with the words from its last shared word on, and one more for each shared word before it.

    ``prefix`` has one word more than the prefix filter needs, unless the set itself has no more; the first ``rare`` are rare.
    Where ``before`` is true a key has also ``before``: which words would make an earlier key with any set that shares this key
    and has the same word there. The upper bits say by which key: the word's own (0), or with this key's first word, after (1)
    or before it (2).
    """
    singles = _prefix(n, percent)
    alone = F.when((F.lit(100) * n >= F.lit(percent * PAIRED)) | (n > PAIRED), singles).otherwise(rare)
    kind = lambda ts, k: F.transform(ts, lambda t: t.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(k << 32)))
    seen = lambda *parts: [] if before is None else [F.when(before, F.concat(*parts)).alias("before")]
    one = F.transform(F.slice(prefix, F.lit(1), alone), lambda t, i: F.struct(t.cast("long").alias("key"), (n - i).alias("left"), *seen(kind(F.slice(prefix, F.lit(1), i), 0))))

    def pairs(t: Column, i: Column) -> Column:
        others = lambda j: seen(kind(F.slice(prefix, F.lit(1), F.least(alone, i)), 0), kind(F.slice(prefix, alone + 1, F.greatest(i - alone, F.lit(0))), 1), kind(F.slice(prefix, i + 2, j), 2))
        return F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda u, j: F.struct(F.xxhash64(t, u).alias("key"), (n - i - j).alias("left"), *others(j)))

    two = F.flatten(F.transform(F.slice(prefix, rare + 1, singles - rare), lambda t, i: pairs(t, i + rare)))
    return F.when(n > PAIRED, one).otherwise(F.concat(one, two))


def _classes(docs: DataFrame, percent: int, sketch: bool) -> DataFrame:
    """A row per class of the lines of ``docs`` (``id, text``), with the columns of ``REST``; with ``sketch`` also four pairs of four of its word hashes."""
    # A constant: Spark makes the array once, on the driver.
    scale = F.split(F.lit(",".join(map(str, rarity(docs)))), ",").cast("array<long>")
    lines = docs.select("id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("line", "words"))
    # Filtered on the line itself: a condition on its words would have Spark cut and sort them twice.
    # Each array in a step of its own: Spark would make one anew for every column that it goes into.
    lines = lines.where(~_blank(F.col("words"))).select("id", "print", "line", _hashes(F.col("words")).alias("hashes"))
    # Lowest and highest once more after other bits are turned over: four samples of the set's words. One of them alone is often
    # a common word, whose early classes have nothing to do with a set; two together are seldom shared but by near-equal sets.
    turned = [F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(TURN))).alias("turned")] if sketch else []
    lines = lines.select("id", "print", "line", "hashes", _tokens(F.col("hashes"), scale).alias("tokens"), *turned)
    if sketch:
        lines = lines.withColumn("samples", F.array(*(f(h) for h in ("hashes", "turned") for f in (F.array_min, F.array_max))))
    sample = lambda i: F.get("samples", F.lit(i))
    lines = lines.select(
        F.struct("id", "print", "line").alias("at"),
        F.xxhash64("tokens").alias("x"),
        F.xxhash64(F.lit(5), "tokens").alias("y"),
        F.size("tokens").alias("n"),
        F.transform(F.slice("tokens", F.lit(1), _prefix(F.size("tokens"), percent) + 1), lambda t: F.shiftright(F.shiftleft(t, 32), 32).cast("int")).alias("prefix"),
        F.size(F.filter(F.slice("tokens", F.lit(1), _prefix(F.size("tokens"), percent)), lambda t: F.shiftrightunsigned(t, 57) < COMMON)).alias("rare"),
        *(_map(F.col("tokens"), i).alias(f"map{i}") for i in (0, 1)),
        *([F.array(*(F.hash(F.lit(k), sample(i), sample(j)) for k, (i, j) in enumerate(SAMPLED))).alias("ends")] if sketch else []),
    )
    rest = (*REST, "ends") if sketch else REST
    # Grouped by plain longs, which are sorted by their bits.
    classes = lines.groupBy("x", "y").agg(F.min("at").alias("first"), *(F.first(c).alias(c) for c in rest))
    return written(classes.select(F.struct("x", "y").alias("class"), "first", *rest), "classes")


def _enough(percent: int) -> Column:
    """Words shared by two linked sets of n and m: at least ceil(t (n + m) / (1 + t)). In whole numbers throughout."""
    return F.floor((F.lit(percent) * (F.col("n_a") + F.col("n_b")) + 99 + percent) / (100 + percent)).cast("int")


def _alike(percent: int) -> Column:
    """Sizes and sketches leave a link possible."""
    sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return sizes & (_apart() <= F.col("n_a") + F.col("n_b") - 2 * _enough(percent))


def _sharing(classes: DataFrame, percent: int, apart: Column, done: Column, *more: str, close: Column | None = None) -> DataFrame:
    """``x_a, x_b``, names of classes that share a key and may be linked, a row for each key that makes them a pair.

    ``apart`` says which of both orders counts, on columns ``more`` too; classes that are ``done`` are only found, as ``a``. Two
    near-equal sets share many keys: two classes that are ``close`` to others are made into a pair at the first one only.
    """
    # Probes name a class by one of its hashes; the sets that are compared in the end are those of all classes of that name.
    mine = (F.col("class.x").alias("x"), "n", "map0", "map1", *more)
    probes = classes.select(*mine, done.alias("done"), F.explode(_keys(F.col("prefix"), F.col("rare"), F.col("n"), percent, close)).alias("k"))
    more = (*more, *(["before"] if close is not None else []))
    # The sign says who is done: a filter of one side alone would have Spark shuffle the probes twice.
    probes = probes.select("k.*", "done", "x", "n", "map0", "map1", *(c for c in more if c != "before"))
    probes = probes.withColumn("left", F.when(F.col("done"), -F.col("left")).otherwise(F.col("left"))).drop("done")
    a, b = (probes.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("x", "n", "left", "map0", "map1", *more))) for s in ("a", "b"))
    alike = apart & (F.least(F.abs("left_a"), "left_b") >= _enough(percent)) & _alike(percent)
    if close is not None:
        alike &= ~F.coalesce(F.arrays_overlap("before_a", "before_b"), F.lit(False))
    return a.join(b, "key").where(alike).select("x_a", "x_b")


def _candidates(*args, **more) -> DataFrame:
    """The different pairs of ``_sharing``."""
    return written(_sharing(*args, **more).distinct(), "pairs")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``a, b, n_a, n_b, both, apart``: firsts of the linked classes among ``pairs``, ``a`` before ``b``, by the whole sets of the lines in question, from their own texts.

    ``n_a, n_b, both`` count the words of each and of both, ``apart`` holds the words that only one of them has. Besides
    these the firsts of all classes among ``pairs``.
    """
    asked = pairs.select(F.explode(F.array("x_a", "x_b")).alias("x")).distinct()
    asked = asked.join(classes.select(F.col("class.x").alias("x"), "first"), "x")
    asked = asked.groupBy(F.col("first.id").alias("id"), F.col("first.print").alias("print")).agg(F.collect_set(F.struct("x", F.col("first.line").alias("line"))).alias("asked"))
    texts = docs.select("id", "text", F.xxhash64("text").alias("print")).alias("d")
    sets = texts.join(asked.alias("q"), F.col("d.id").eqNullSafe(F.col("q.id")) & (F.col("d.print") == F.col("q.print")))
    sets = sets.select("d.id", "d.print", F.split("text", "\n").alias("all"), F.explode("asked").alias("one"))
    sets = sets.select("one.x", F.struct("id", "print", "one.line").alias("at"), F.array_distinct(_words(F.get("all", F.col("one.line")))).alias("words"))
    sets = written(sets.dropDuplicates(["at"]), "sets")

    left, right = (sets.select(*(F.col(c).alias(f"{c}_{s}") for c in ("x", "at", "words"))) for s in ("a", "b"))
    close = pairs.join(left, "x_a").join(right, "x_b").withColumn("both", F.size(F.array_intersect("words_a", "words_b")))
    links = close.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("words_a") + F.size("words_b") - F.col("both")))
    forward = F.col("at_a") < F.col("at_b")
    ends = [F.when(forward, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) for c in ("at", "words")]
    ends += [F.when(forward, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")) for c in ("at", "words")]
    apart = F.concat(F.array_except("words_a", "words_b"), F.array_except("words_b", "words_a"))
    return links.select(ends[0].alias("a"), ends[2].alias("b"), F.size(ends[1]).alias("n_a"), F.size(ends[3]).alias("n_b"), "both", apart.alias("apart")), sets.select(F.col("at").alias("first"))


def _early(classes: DataFrame, percent: int) -> DataFrame:
    """``x_a, x_b``: each class and at most ``SALTS`` early classes of those that share one of four pairs of samples of its word hashes."""
    one = classes.select("first", F.col("class.x").alias("x"), "n", "map0", "map1", F.explode("ends").alias("key"))
    early = one.groupBy("key", F.pmod(F.col("x"), F.lit(SALTS)).alias("salt")).agg(F.min(F.struct("first", "x", "n", "map0", "map1")).alias("e"))
    early = early.select("key", F.col("e.first.id").alias("id_a"), *(F.col(f"e.{c}").alias(f"{c}_a") for c in ("x", "n", "map0", "map1")))
    mine = one.select("key", F.col("first.id").alias("id_b"), *(F.col(c).alias(f"{c}_b") for c in ("x", "n", "map0", "map1")))
    near = mine.join(early, "key").where(_before() & (F.col("x_a") != F.col("x_b")) & _alike(percent))
    return written(near.select("x_a", "x_b").distinct(), "near")


def _before() -> Column:
    return F.col("id_a").isNull() | (F.col("id_a") <= F.col("id_b"))


def _star(early: DataFrame, percent: int) -> DataFrame:
    """``pivot, first, far, top, apart``: classes by the earliest one that they were found linked with, and that one, if it has none itself.

    With a and b words of the pivot that two members lack, they share all of its words but a + b, and besides as many words as
    their ``apart`` do. So they are linked if (100 + percent) times what their ``apart`` share is at least the sum of their
    ``far`` less ``top``, where ``far`` is (100 + percent) a + percent n, and ``top`` is (100 + percent) times the pivot's words.
    """
    whole = F.lit(100 + percent).cast("long")
    mine = early.select("b", F.struct("a", "n_a", "n_b", "both", "apart").alias("p")).groupBy("b").agg(F.min("p").alias("p"))
    mine = mine.select(
        F.col("p.a").alias("pivot"),
        F.col("b").alias("first"),
        (whole * (F.col("p.n_a") - F.col("p.both")) + F.lit(percent) * F.col("p.n_b")).alias("far"),
        (whole * F.col("p.n_a")).alias("top"),
        F.col("p.apart").alias("apart"),
    )
    mine = written(mine, "members")
    centres = mine.groupBy("pivot").agg(F.first("top").alias("top")).join(mine.select(F.col("first").alias("pivot")), "pivot", "left_anti")
    none = F.array().cast("array<string>")
    # The far of a pivot is percent times its words.
    return mine.unionByName(centres.select("pivot", F.col("pivot").alias("first"), F.expr(f"top div {100 + percent} * {percent}").alias("far"), "top", none.alias("apart")))


def _star_links(star: DataFrame, percent: int) -> DataFrame:
    """``first, links``: how many members of its own star a class is linked with."""
    members = star.groupBy("pivot", "far", "top").agg(F.count("*").alias("n"))
    # Pairs that are linked by what they share with the pivot alone: counted by far, of which a star has few values.
    others = members.select("pivot", F.col("far").alias("their"), F.col("n").alias("m"))
    sure = members.join(others, "pivot").groupBy("pivot", "far", "top").agg(F.sum(F.when(F.col("far") + F.col("their") <= F.col("top"), F.col("m")).otherwise(0)).alias("m"), F.max("their").alias("farthest"))
    sure = star.join(sure, ["pivot", "far", "top"]).withColumn("m", F.col("m") - F.when(2 * F.col("far") <= F.col("top"), 1).otherwise(0))
    sure = written(sure, "star")

    # The others are only if their apart share words, which are looked up. Up to FEW of them go along, so that a pair that shares too few is let go at once.
    asked = sure.where(F.col("far") + F.col("farthest") > F.col("top"))
    asked = asked.select("pivot", "first", "far", "top", F.when(F.size("apart") <= FEW, F.col("apart")).alias("few"), F.explode("apart").alias("word"))
    left, right = (asked.select("pivot", "word", *([F.col("top")] if s == "a" else []), *(F.col(c).alias(f"{c}_{s}") for c in ("first", "far", "few"))) for s in ("a", "b"))
    over = F.col("far_a") + F.col("far_b") - F.col("top")
    shared = F.lit(100 + percent) * F.coalesce(F.size(F.array_intersect("few_a", "few_b")), F.size("few_a"), F.size("few_b"))
    either = F.col("few_a").isNull() | F.col("few_b").isNull() | (shared >= over)
    pairs = left.join(right, ["pivot", "word"]).where((F.col("first_a") < F.col("first_b")) & (over > 0) & either)
    pairs = pairs.groupBy("first_a", "first_b", over.alias("over")).agg(F.count("*").alias("shared")).where(F.lit(100 + percent) * F.col("shared") >= F.col("over"))
    more = pairs.select(F.explode(F.array("first_a", "first_b")).alias("first"), F.lit(1).cast("long").alias("m"))
    return sure.select("first", "m").unionByName(more).groupBy("first").agg(F.sum("m").alias("links"))


def link_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The classes of ``docs``, and how many others each is linked with.

    Classes: ``class, first, n``, where ``first`` is the struct
    ``id, print, line`` of the first line in reading order (id, then the text's hash, then the line's number); counts:
    ``first, links, later`` of the linked ones, where ``later`` is 1 if an earlier class is among the others, else 0.

    A group of near-equal lines has as many links as its square. Most of these are not made but counted: by stars, each of an
    early class and those that were found linked with it (``_star``). Links between stars, and of classes in none, are made.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    classes = _classes(docs, percent, sketch=True)
    early, close = _verified(docs, classes, _early(classes, percent), percent)
    star = written(_star(early, percent), "stars")
    inside = written(_star_links(star, percent), "inside")

    close = close.join(star.select("first", F.xxhash64("pivot").alias("star")), "first", "left").withColumn("close", F.lit(True))
    marked = classes.join(close, "first", "left")
    other = F.col("x_a") < F.col("x_b")
    other &= F.col("star_a").isNull() | F.col("star_b").isNull() | (F.col("star_a") != F.col("star_b"))
    pairs = _candidates(marked, percent, other, F.lit(False), "star", close=F.col("close").isNotNull())
    links = written(_verified(docs, classes, pairs, percent)[0].select("a", "b"), "links")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("first"), F.lit(0).alias("later")), F.struct(F.col("b").alias("first"), F.lit(1).alias("later")))).alias("e"))
    between = ends.select("e.first", F.lit(1).cast("long").alias("links"), "e.later")
    inside = inside.join(star.select("first", (F.col("first") != F.col("pivot")).cast("int").alias("later")), "first")
    return classes.select("class", "first", "n"), between.unionByName(inside).groupBy("first").agg(F.sum("links").alias("links"), F.max("later").alias("later"))


def later_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The classes as of ``link_counts``, and ``first`` of every class that is linked with an earlier one, without all links.

    A group of near-equal lines has as many links as its square, but one link to an earlier line decides a line. So each class
    is first held against at most ``SALTS`` early classes of those that share one of four pairs of samples of its word hashes.
    Only classes that this leaves open look for all their earlier partners, among all classes, by the join of ``link_counts``: what
    is found is exact.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    classes = _classes(docs, percent, sketch=True)
    found, _ = _verified(docs, classes, _early(classes, percent), percent)
    found = written(found.select(F.col("b").alias("first")).distinct(), "found")

    marked = classes.join(found.withColumn("found", F.lit(True)), "first", "left").withColumn("id", F.col("first.id"))
    pairs = _candidates(marked, percent, _before() & (F.col("x_a") != F.col("x_b")), F.col("found").isNotNull(), "id")
    links, _ = _verified(docs, classes, pairs, percent)
    return classes.select("class", "first", "n"), found.unionByName(links.select(F.col("b").alias("first"))).distinct()


def remove_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, count: bool = True) -> DataFrame:
    """``docs`` with every column, ``text`` without its repeated lines, and ``n_lines``, ``n_removed``, ``n_links`` besides.

    A line goes if an earlier line, in order of id (null first), then of the text's hash, then of place, has ``percent`` % or
    more of their words in common; all comparisons are on the input. Lines without words stay, and so does a null text, with
    0 lines. Rows that repeat both id and text are one document. ``n_links`` counts the classes that those of the document's
    lines are linked with; without ``count`` it is left out, the same lines go, and no square of a group of near-equal lines is
    made. Columns of ``docs`` named as those added are replaced.
    """
    if count:
        classes, degrees = link_counts(docs, id, text, percent)
    else:
        classes, later = later_classes(docs, id, text, percent)
        degrees = written(later, "later").select("first", F.lit(0).cast("long").alias("links"), F.lit(1).alias("later"))
    marked = classes.join(degrees, "first", "left").select("class", F.col("first").alias("at"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("later", F.lit(0)).alias("later"))
    # Only firsts can stay; every document learns of its own firsts, and the count of its lines it knows itself.
    per_doc = marked.groupBy(F.col("at.id").alias("k_id"), F.col("at.print").alias("k_print")).agg(
        F.sort_array(F.collect_list(F.when(F.col("later") == 0, F.col("at.line")))).alias("k_stay"), F.sum("links").alias("k_links")
    )
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id).alias("r_id"), F.xxhash64(F.col(text)).alias("r_print"))
    rows = rows.join(per_doc, F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_print") == F.col("k_print")), "left")
    own = F.col(f"doc.`{text}`")
    split = F.split(own, "\n")
    stay = F.coalesce("k_stay", F.array().cast("array<int>"))
    # A byte a line up to the last that stays: finding it in a list would take the square of a long document's lines.
    gap = lambda x, i: x - F.when(i > 0, F.get(stay, i - 1)).otherwise(-1) - 1
    marks = F.array_join(F.transform(stay, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1"))), "").cast("binary")
    rows = rows.withColumn("k_marks", marks)
    kept = F.filter(split, lambda x, i: (F.substring("k_marks", i + 1, F.lit(1)) == F.lit(b"1")) | _blank(x))
    out = {"text": F.array_join(kept, "\n"), "n_lines": F.coalesce(F.size(F.filter(split, lambda x: ~_blank(x))), F.lit(0))}
    rows = rows.withColumn("o_text", F.when(own.isNotNull(), out["text"])).withColumn("o_lines", F.when(own.isNull(), 0).otherwise(out["n_lines"]))
    added = {"n_lines": F.col("o_lines"), "n_removed": F.col("o_lines") - F.size(stay)} | ({"n_links": F.coalesce("k_links", F.lit(0))} if count else {})
    columns = [F.col("o_text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns if c not in added]
    return rows.select(*columns, *(v.alias(c) for c, v in added.items()))
