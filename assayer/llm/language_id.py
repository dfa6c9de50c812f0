"""The languages of documents, as mixtures of character n-gram models.

Each language is a smoothed distribution of ``GRAM``-byte grams, hashed to ``BUCKETS``. A document's grams are taken for draws
from a mixture of languages, whose proportions expectation-maximisation estimates. The set of languages then grows by the one
with the next largest proportion as long as the penalised likelihood rises, up to all of them: a further language must pay
``penalty`` times the logarithm of the document's grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.words import buffer, slices

GRAM, BUCKETS, SMOOTHING = 4, 1 << 15, 0.5
ROUNDS, PENALTY = 12, 4.0
#: By how many nats a gram, and by how many deviations of its mean besides, a text may be less likely than its languages' own texts.
STRANGE, DEVIATIONS = 3.0, 6.0
UNKNOWN = "und"

#: Upper case to lower case; all other ASCII but letters to a space.
_PLAIN = np.where(np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint32)
_PLAIN[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    """``logp[g, l]`` is the log-probability of gram bucket g in language l."""

    languages: list[str]
    logp: np.ndarray

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the log-probability of each language's own grams."""
        log = self.logp.astype(float)
        mean = (np.exp(log) * log).sum(axis=0)
        return mean, np.sqrt(np.maximum((np.exp(log) * log**2).sum(axis=0) - mean**2, 0))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct gram buckets: text, bucket and count, in order of text."""
    pad, none = (pa.scalar(x, pa.large_string()) for x in ("  ", ""))
    padded = pc.binary_join_element_wise(pad, column.cast(pa.large_string()).fill_null(""), pad, none)
    data, offsets = buffer(padded)
    b = _PLAIN[data]
    n = len(b) - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(0x01000193) ^ b[i : i + n]
    bucket = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = (doc[:n] == doc[GRAM - 1 :]) & ((b[:n] != 32) | (b[1 : n + 1] != 32))
    key, count = np.unique(doc[:n][whole] * BUCKETS + bucket[whole], return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            doc, bucket, count = grams(part.column("text"))
            langs, which = np.unique(np.array(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            for i, lang in enumerate(langs):
                mine = which[doc] == i
                total.setdefault(lang, np.zeros(BUCKETS))
                total[lang] += np.bincount(bucket[mine], count[mine], BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model of all rows whose text and language are not null. The driver gets ``BUCKETS`` numbers a language at most."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    table[counts["bucket"].to_numpy(dtype=np.int64), np.searchsorted(languages, counts["lang"].to_numpy(dtype=str)) if languages else []] += counts["n"].to_numpy(dtype=float)
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _em(p: np.ndarray, doc: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text after some rounds, and the log-likelihood of its grams under them. ``doc`` numbers 0..n - 1."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    total = np.add.reduceat(count, first)
    for _ in range(rounds):
        r = p * share[doc]
        r *= (count / np.maximum(r.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(r, first, axis=0) / total[:, None]
    return share, np.add.reduceat(count * np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-30)), first)


def mixtures(column: pa.Array, model: LanguageModel, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language proportions, 0 for languages outside its set; all 0 for a text without a gram. And whether it is strange: less
    likely than the texts of its languages by ``STRANGE`` nats a gram and ``DEVIATIONS`` deviations of a mean over as many grams."""
    out, strange = np.zeros((len(column), len(model.languages))), np.zeros(len(column), bool)
    doc, bucket, count = grams(column)
    if not len(doc) or not model.languages:
        return out, strange
    some, doc = np.unique(doc, return_inverse=True)
    log = model.logp[bucket]
    p = np.exp(log - log.max(axis=1, keepdims=True))
    count = count.astype(np.float32)
    share, _ = _em(p, doc, count, np.full((len(some), p.shape[1]), 1 / p.shape[1], np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    grams_of = np.bincount(doc, count)
    best, score = np.zeros_like(share), np.full(len(some), -np.inf)
    live = np.arange(len(some))  # texts whose set may still grow
    for k in range(1, p.shape[1] + 1):
        start = np.where(rank[live] < k, np.maximum(share[live], 1e-6), 0)
        here = np.isin(doc, live) if len(live) < len(some) else slice(None)
        mine, ll = _em(p[here], np.searchsorted(live, doc[here]), count[here], (start / start.sum(axis=1, keepdims=True)).astype(np.float32), 0 if k == 1 else ROUNDS // 2)
        ll = ll - penalty * (k - 1) * np.log(grams_of[live] + 1)
        rises = ll > score[live]
        live = live[rises]
        best[live], score[live] = mine[rises], ll[rises]
        if not len(live):
            break
    out[some] = best
    mean, deviation = model.own()
    likely = np.bincount(doc, count * (np.log(np.maximum((p * best[doc]).sum(axis=1), 1e-30)) + log.max(axis=1))) / grams_of
    strange[some] = best @ mean - likely > STRANGE + DEVIATIONS * (best @ deviation) / np.sqrt(grams_of)
    return out, strange


_MIXTURE = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _identify(model, columns: list[str], penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text", max(1 << 16, (1 << 22) // max(4, len(m.languages)))):
                share, strange = mixtures(part.column("text"), m, penalty)
                share[~np.array(part.column("lettered").to_pylist(), dtype=bool)] = 0
                top = share.argmax(axis=1) if m.languages else np.zeros(len(part), int)
                score = share.max(axis=1, initial=0)
                langs = [m.languages[t] if s > 0 else UNKNOWN for t, s in zip(top, score, strict=True)]
                mix = [[{"lang": m.languages[i], "share": float(x[i])} for i in np.argsort(-x, kind="stable") if x[i] > 0] for x in share]
                yield pa.RecordBatch.from_arrays([*part.column("row").flatten()[1:], pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mix, _MIXTURE), pa.array(strange & (score > 0))], [*columns, "lang_pred", "score", "lang_mix", "strange"])

    return run


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` with the columns ``keep`` (all) and ``lang_pred``, ``score``, ``lang_mix`` and ``strange`` after them.

    ``lang_mix`` lists the languages of the chosen set and their proportions, largest first; ``lang_pred`` is the first, and
    ``score`` its proportion. A null text or one without a letter is ``und`` with score 0, and all are if the model knows no
    language. ``strange`` tells texts that are in none of the languages, as far as their grams say: random letters, encoded data, other
    languages; short texts hardly ever are. Columns of ``docs`` named as those added are replaced.
    """
    added = ("lang_pred", "score", "lang_mix", "strange")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text).alias("text"), lettered(F.col(text)).alias("lettered"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, lang_mix array<struct<lang: string, share: double>>, strange boolean"])
    return rows.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(model), keep, penalty), schema)
