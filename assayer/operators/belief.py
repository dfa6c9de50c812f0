"""Belief functions: verdicts as mass functions, combined by products of commonalities.

A verdict puts mass on at most three sets (none, its own, the whole frame), so the commonality of any set A is a closed form, and
the conjunctive rule multiplies commonalities. Combining is thus a grouped product without an order: Spark multiplies by key and verdict, and
what a key's verdicts say of all sets is then worked out in numpy for a batch of keys at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from assayer.functions.verdicts import clamp, full, has

#: At this conflict nothing can be said: every stage has probability 0.
CEILING = 0.9999
#: Numbers that a task holds at once of what verdicts, or keys, say of each set.
HELD = 1 << 20
#: The two worlds: in the closed one abstentions are left out.
WORLDS = {"tbm": False, "closed_world": True}


def _given(c: str) -> Column:
    return F.when(F.col(c) == 0, 1.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(1.0)))


def factor(closed: bool, legacy: bool = False) -> Column:
    """What a response multiplies the commonalities of the sets it speaks against by; of all sets, if it abstains or names the whole scale.

    By the older rule (``legacy_bodies``) a 0 counts like a missing value, as 1, and what abstentions and whole scales say is not clamped.
    """
    a, o, d = (_given(c) for c in ("agreement", "obs", "disc")) if legacy else (clamp(F.col(c)) for c in ("agreement", "obs", "disc"))
    v = clamp(a if closed else a * o * d) if legacy or not closed else a
    mask = F.col("mask")
    return F.when(mask == 0, F.lit(1.0) if closed else 1 - a).when(mask == full(F.col("scale_size")), F.lit(1.0) if closed else a).otherwise(1 - v)


def _combined_batches(batches: Iterator[pa.RecordBatch], by: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose rows of one key and verdict are multiplied or added up, if that makes them much shorter."""
    for batch in batches:
        mixed = batch.column("_hash").to_numpy() ^ (batch.column("mask").fill_null(-1).to_numpy() * np.int64(-7046029254386353131))
        if 2 * len(np.unique(mixed)) < len(mixed):
            rest = [c for c in batch.schema.names if c not in by]
            one = pa.Table.from_batches([batch]).group_by(by).aggregate([(c, "sum" if c in sums else "product") for c in rest])
            named = {f"{c}_sum" if c in sums else f"{c}_product": c for c in rest}
            yield from one.rename_columns([named.get(c, c) for c in one.column_names]).select(batch.schema.names).to_batches()
        else:
            yield batch


def _changes(x: pa.Array) -> np.ndarray:
    """Whether each value after the first differs from the one before; nulls are equal."""
    a, b = x.slice(1), x.slice(0, len(x) - 1)
    either = pc.xor(a.is_null(), b.is_null())
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), either).to_numpy(zero_copy_only=False)


#: What is worked out of rows of one scale: from their masks (-1: unknown) and columns, arrays of a row each and how they are combined.
Measures = Callable[[int, np.ndarray, dict[str, np.ndarray]], list[tuple[np.ufunc, np.ndarray]]]


def by_key(responses: DataFrame, keys: list[str], products: dict[str, Column], sums: dict[str, Column], measured: Measures, found: Callable[..., list[np.ndarray]], beside: DataFrame | None = None, **columns: DataType) -> DataFrame:
    """``keys, scale_size`` and ``columns``, by name and type: ``found`` makes them of the scale and what was ``measured``, combined over each key's responses.

    Responses of one key and verdict are multiplied (``products``) and added up (``sums``) before they leave a task, where that makes them
    fewer. They are then dealt out once by key and sorted, and a task works through them with numpy; of a key that goes on it only keeps what was
    combined so far, so a key may have any number of responses. ``found`` returns an array for each column, of a row or a number a
    key; masked numbers and rows are null. Rows without a scale are left out. With ``beside``, whose columns are some of ``keys`` and numbers,
    responses are joined with it before they are dealt out, so that what is known of a larger group needs no later join.
    """
    named, added, parts = [*keys, "scale_size"], list(sums), [*products, *sums]
    rows = responses.where("scale_size is not null").select(F.xxhash64(*named).alias("_hash"), *named, F.col("mask").cast("long").alias("mask"), *(x.alias(c) for c, x in (products | sums).items()))
    rows = rows.mapInArrow(lambda batches: _combined_batches(batches, ["_hash", *named, "mask"], added), rows.schema)
    if beside is not None:
        parts += [c for c in beside.columns if c not in keys]
        rows = rows.join(beside, [c for c in beside.columns if c in keys]).select("_hash", *named, "mask", *parts)
    rows = rows.repartition("_hash").sortWithinPartitions("_hash", *named)  # after the join, which may be broadcast or split where it is skewed
    schema = StructType([*(rows.schema[k] for k in named), *(StructField(name, kind) for name, kind in columns.items())])

    def listed(x: np.ndarray) -> pa.Array:
        gone = np.ma.getmaskarray(x)
        if x.ndim == 1:
            return pa.array(np.ma.getdata(x), mask=gone)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ma.getdata(x).ravel()), mask=pa.array(gone[:, 0]))

    def finished(n: int, of: pa.RecordBatch, values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*of.columns, *map(listed, found(n, *values))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[pa.RecordBatch, list[np.ndarray]]] = {}  # by scale, the last key and what was combined of it
        for batch in batches:
            scales = batch.column("scale_size")
            for n in map(int, scales.unique().to_pylist()):
                mine, most = batch.filter(pc.equal(scales, n)), max(HELD >> n, 1)
                for at in range(0, len(mine), most):
                    part = mine.slice(at, most)
                    starts = np.concatenate([[0], 1 + np.flatnonzero(np.logical_or.reduce([_changes(part.column(k)) for k in named]))]).astype(int)
                    of = part.select(named).take(pa.array(starts))
                    mask = part.column("mask").fill_null(-1).to_numpy()
                    combine, each = zip(*measured(n, mask, {c: part.column(c).to_numpy(zero_copy_only=False) for c in parts}), strict=True)
                    values = [f.reduceat(x, starts, axis=0) for f, x in zip(combine, each, strict=True)]
                    if n in held:
                        last, old = held[n]
                        if last.to_pylist() == of.slice(0, 1).to_pylist():
                            for f, x, o in zip(combine, values, old, strict=True):
                                x[0] = f(o[0], x[0])
                        else:
                            of, values = pa.concat_batches([last, of]), [np.concatenate(x) for x in zip(old, values, strict=True)]
                    held[n] = of.slice(len(of) - 1), [x[-1:].copy() for x in values]
                    if len(of) > 1:
                        yield finished(n, of.slice(0, len(of) - 1), [x[:-1] for x in values])
        for n, (last, values) in held.items():
            yield finished(n, last, values)

    return rows.mapInArrow(run, schema)


def against(n: int, mask: np.ndarray, factors: np.ndarray) -> tuple[np.ufunc, np.ndarray]:
    """What each response multiplies the commonality of each set by: it counts for the sets it doesn't hold; abstentions and whole scales for all, unknown ones for none."""
    counts = (np.arange(1 << n) & ~mask[:, None]) != 0
    counts[(mask == 0) | (mask == (1 << n) - 1)] = True
    counts[mask < 0] = False
    counts[:, 0] = False
    return np.multiply, np.where(counts, factors[:, None], 1.0)


def bets(n: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of commonalities each row's probabilities of the stages, all 0 where the conflict reaches ``CEILING``, and its conflict."""
    sets = np.arange(1 << n)
    sign = np.where(np.bitwise_count(sets) % 2 == 0, 1.0, -1.0)
    share = np.where((sets[:, None] >> np.arange(n)) & 1 == 1, -sign[:, None] / np.maximum(np.bitwise_count(sets), 1)[:, None], 0.0)
    conflict = q @ sign
    bet = (q @ share) / np.maximum(1 - conflict, 1e-12)[:, None]
    return np.where((conflict >= CEILING)[:, None], 0.0, bet), conflict


def _one_world(responses: DataFrame, keys: list[str], closed: bool, legacy: bool, found: Callable[..., list[np.ndarray]], **columns: DataType) -> DataFrame:
    rows = responses.where("mask <> 0") if closed else responses
    return by_key(rows, keys, {"factor": factor(closed, legacy)}, {}, lambda n, mask, of: [against(n, mask, of["factor"])], found, **columns)


def commonalities(responses: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """``keys, scale_size, q``: the commonality of every set of stages, by its mask; in the closed world abstentions are left out."""
    return _one_world(responses, keys, closed, False, lambda n, q: [q], q=ArrayType(DoubleType()))


def beliefs(responses: DataFrame, keys: list[str], closed: bool = False, legacy: bool = False) -> DataFrame:
    """``keys, scale_size, bet, conflict``: the pignistic probabilities of the stages as an array, without writing down commonalities.

    With ``legacy`` they are those of ``combined_bodies`` of ``legacy_bodies``; no body is made, and no set of a response leaves a task.
    """
    return _one_world(responses, keys, closed, legacy, lambda n, q: list(bets(n, q)), bet=ArrayType(DoubleType()), conflict=DoubleType())


def worlds(responses: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, scale_size`` and for both worlds ``<world>_conflict, <world>_expected_stage``, from one pass; the closed world's are null where all abstain."""

    def measured(n: int, mask: np.ndarray, of: dict[str, np.ndarray]) -> list[tuple[np.ufunc, np.ndarray]]:
        return [*(against(n, mask, of[w]) for w in WORLDS), (np.logical_or, mask > 0)]

    def found(n: int, *values: np.ndarray) -> list[np.ndarray]:
        out = []
        for closed, q in zip(WORLDS.values(), values, strict=False):
            bet, conflict = bets(n, q)
            out += [np.ma.masked_where(closed & ~values[-1], x) for x in (conflict, bet @ np.arange(1.0, n + 1))]
        return out

    return by_key(responses, keys, {w: factor(closed) for w, closed in WORLDS.items()}, {}, measured, found, **{f"{w}_{c}": DoubleType() for w in WORLDS for c in ("conflict", "expected_stage")})


def _signed(q: Column, term: Callable[[Column], Column]) -> Column:
    """The sum of (-1) ** |A| q(A) over all sets, each by a factor of its mask."""
    signed = F.transform(q, lambda x, i: F.when(F.bit_count(i) % 2 == 0, x).otherwise(-x) * term(i.cast("long")))
    return F.aggregate(signed, F.lit(0.0), lambda m, x: m + x)


def pignistic(q: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, stage, bet_p, conflict`` for each stage; all 0 where the conflict reaches ``CEILING``. ``beliefs`` does the same from responses."""
    rows = q.select(*keys, "scale_size", "q", _signed(F.col("q"), lambda i: F.lit(1.0)).alias("conflict"))
    raw = F.transform(F.sequence(F.lit(1), F.col("scale_size").cast("int")), lambda s: -_signed(F.col("q"), lambda i: F.when(has(i, s), 1 / F.bit_count(i)).otherwise(0.0)))
    rows = rows.select(*keys, "conflict", F.posexplode(raw).alias("at", "raw"))
    bet = F.when(F.col("conflict") >= CEILING, 0.0).otherwise(F.col("raw") / F.greatest(1 - F.col("conflict"), F.lit(1e-12)))
    return rows.select(*keys, (F.col("at") + 1).alias("stage"), bet.alias("bet_p"), "conflict")


def by_stage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, stage, bet_p, conflict``: ``beliefs`` with a row a stage."""
    return rows.select(*keys, "conflict", F.posexplode("bet").alias("at", "bet_p")).select(*keys, (F.col("at") + 1).alias("stage"), "bet_p", "conflict")


def _butterflies(values: Column, size: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``values`` by subset after, for each stage in turn, a set without it takes in the set that has it besides: n * 2**n steps."""

    def stage(v: Column, bit: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1), bit)
        return F.transform(v, lambda x, i: F.when(i.bitwiseAND(one) == 0, step(x, F.get(v, i + one))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), size.cast("int") - 1), values, stage)


def zeta(masses_: Column, size: Column) -> Column:
    """Commonalities of masses by subset: each set's is the mass of all sets that hold it."""
    return _butterflies(masses_, size, lambda without, with_: without + with_)


def moebius(q: Column, size: Column) -> Column:
    """Masses of commonalities by subset, the inverse of ``zeta``."""
    return _butterflies(q, size, lambda without, with_: without - with_)


def masses(q: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, subset, mass`` by Moebius inversion."""
    rows = q.select(*keys, F.posexplode(moebius(F.col("q"), F.col("scale_size"))).alias("subset", "mass"))
    return rows.withColumn("subset", F.col("subset").cast("long"))


def combined_bodies(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, scale_size, q``: the conjunctive combination of any bodies of evidence, as commonalities.

    ``bodies`` has ``keys, scale_size, masses``, a map from subsets, by mask, to masses; sets not in the map have none. Equal bodies of a key
    are multiplied before they leave a task. A null map says nothing and is left out.
    """
    whole = full(F.col("scale_size"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), whole), lambda i: F.coalesce(F.try_element_at("masses", i), F.lit(0.0)))
    rows = bodies.where("masses is not null").select(*keys, "scale_size", F.posexplode(zeta(dense, F.col("scale_size"))).alias("subset", "x"))
    each = rows.groupBy(*keys, "scale_size", "subset").agg(F.product("x").alias("x"))
    by_subset = F.sort_array(F.collect_list(F.struct("subset", "x")))  # a row a subset
    return each.groupBy(*keys, "scale_size").agg(F.transform(by_subset, lambda s: s["x"]).alias("q"))


def legacy_bodies(responses: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """``keys, scale_size, masses`` of each response by the older rule: a 0 counts like a missing value, as 1, and the mass of an abstention or of
    the whole scale is not clamped. In the closed world an abstention says nothing."""
    a, mask, whole = _given("agreement"), F.col("mask").cast("long"), full(F.col("scale_size"))
    v = clamp(a if closed else a * _given("obs") * _given("disc"))
    none = F.lit(0).cast("long")
    pair = lambda one, x, two: F.map_from_arrays(F.array(one, two), F.array(x, 1 - x))
    abstained = F.lit(None) if closed else pair(none, a, whole)
    said_all = F.create_map(whole, F.lit(1.0)) if closed else pair(whole, a, none)
    return responses.select(*keys, "scale_size", F.when(mask == 0, abstained).when(mask == whole, said_all).otherwise(pair(mask, v, whole)).alias("masses"))


def support(q: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, stage, bel, pl, bet_p, conflict``: mass on the stage alone, and on all sets that hold it, unnormalised."""
    stages = F.transform(F.sequence(F.lit(1), F.col("scale_size").cast("int")), lambda s: F.struct(
        s.alias("stage"), (-_signed(F.col("q"), lambda i: F.when(has(i, s), 1.0).otherwise(0.0))).alias("bel"),
        F.get("q", F.call_function("shiftleft", F.lit(1), s - 1)).alias("pl"),
    ))
    out = q.select(*keys, F.explode(stages).alias("s")).select(*keys, "s.*")
    return out.join(pignistic(q, keys), [*keys, "stage"])


def combined(rows: DataFrame, keys: list[str], usable: float = 0.9) -> DataFrame:
    """One row a key of ``beliefs``: its conflict, if that is low enough to be of use, the largest probability and its stage (the first of equals)."""
    best = F.array_max(F.transform("bet", lambda p, i: F.struct(F.round(p, 9).alias("p"), (-i - 1).alias("s"))))
    out = rows.groupBy(*keys).agg(F.max("conflict").alias("conflict"), F.max(best).alias("best"))
    return out.select(*keys, "conflict", (F.round("conflict", 9) < usable).alias("usable"), F.col("best.p").alias("max_bet_p"), (-F.col("best.s")).alias("modal_stage"))


def bundle_belief(responses: DataFrame, closed: bool = False) -> DataFrame:
    """``experiment_tag, bundle_no, stage, bet_p``: single verdicts' probabilities, averaged with weight obs * disc (else 1)."""
    one = by_stage(beliefs(responses, ["response_id"], closed), ["response_id"])
    weight = F.coalesce("obs", F.lit(1.0)) * F.coalesce("disc", F.lit(1.0))
    weight = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0)
    rows = one.join(responses.select("response_id", "experiment_tag", "bundle_no", weight.alias("w")), "response_id")
    return rows.groupBy("experiment_tag", "bundle_no", "stage").agg((F.sum(F.col("w") * F.col("bet_p")) / F.sum("w")).alias("bet_p"))
