"""Bootstrap intervals and sign-flip tests of mean differences, for groups of any size.

What a replicate draws for a sample is a function of the two: a hash of the sample, then of the replicate. Tasks thus add up their own rows
for all replicates at once, as a product of a table of differences and one of draws, and only sums travel: one row a group, replicate and
task. No group is gathered, and an engine that computes the same whole numbers gets the same draws.

A bootstrap replicate takes each sample as often as a Poisson variable of mean one says, which a multinomial draw of the whole group
becomes when the group is cut up. Samples draw alike in every contrast and endpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The draws' modulus, a prime, and the factors that mix a sample's and a replicate's number.
PRIME, OF_SAMPLE, OF_REPLICATE, MIX = 2147483647, 48271, 69621, (16807, 39373, 1226874159)
#: Differences a task multiplies at a time.
BLOCK = 512
FLIPS_FROM = 1 << 20
#: A flipped mean this close to the observed one is equal to it.
EQUAL = 1e-12


def draws(samples: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """A whole number below ``PRIME`` for each sample and replicate."""
    x = (samples.astype(np.int64)[:, None] % PRIME * OF_SAMPLE + replicates.astype(np.int64) % PRIME * OF_REPLICATE + MIX[2]) % PRIME
    for m in MIX[:2]:
        x = (x * x % PRIME + x * m + 1) % PRIME
    return x


def poisson_limits() -> list[int]:
    """Below the k-th limit a draw means k samples or fewer."""
    share, total, out = math.exp(-1), 0.0, []
    for k in range(9):
        total += share / math.factorial(k)
        out.append(int(total * PRIME))
    return out


def _sums(bootstraps: int, flips: int):
    limits = np.array(poisson_limits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            names = np.array([f"{c}\0{e}" for c, e in zip(batch.column("contrast_id").to_pylist(), batch.column("endpoint").to_pylist(), strict=True)])
            sample, delta = batch.column("sample_ordinal").to_numpy(), batch.column("delta").to_numpy()
            groups, group = np.unique(names, return_inverse=True)
            added = [held.setdefault(tuple(g.split("\0")), np.zeros((3, max(bootstraps, flips)))) for g in groups.tolist()]
            for at in range(0, len(delta), BLOCK):
                part = slice(at, at + BLOCK)
                some, mine = np.unique(group[part], return_inverse=True)
                unit = (mine == np.arange(len(some))[:, None]).astype(float)
                times = np.searchsorted(limits, draws(sample[part], np.arange(bootstraps)), side="right").astype(float)
                signs = (draws(sample[part], np.arange(flips) + FLIPS_FROM) % 2 * 2 - 1).astype(float)
                for g, n, total, flipped in zip(some, unit @ times, unit * delta[part] @ times, unit * delta[part] @ signs, strict=True):
                    added[g][0, :bootstraps] += n
                    added[g][1, :bootstraps] += total
                    added[g][2, :flips] += flipped
        for (contrast, endpoint), x in held.items():
            n = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([contrast] * n), pa.array([endpoint] * n), pa.array(np.arange(n)), *map(pa.array, x)], ["contrast_id", "endpoint", "replicate", "n", "total", "flipped"])

    return run


def resampled(deltas: DataFrame, bootstraps: int = 2000, flips: int = 5000) -> DataFrame:
    """``contrast_id, endpoint, ci_low, ci_high, p_value``: the 2.5 and 97.5 % quantiles of the bootstrap's means, and the two-sided p-value of
    flipped signs.

    Null differences take no part. A single difference is its own interval, and a mean of 0 has p-value 1. A task holds three numbers for
    each of its groups and replicates; groups are contrasts and endpoints, so their number doesn't grow with the samples.
    """
    key = ["contrast_id", "endpoint"]
    rows = deltas.where("delta is not null").select(*key, F.col("sample_ordinal").cast("long").alias("sample_ordinal"), F.col("delta").cast("double").alias("delta"))
    seen = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.avg("delta").alias("mean"))
    sums = rows.mapInArrow(_sums(bootstraps, flips), "contrast_id string, endpoint string, replicate long, n double, total double, flipped double")
    sums = sums.groupBy(*key, "replicate").agg(*(F.sum(c).alias(c) for c in ("n", "total", "flipped"))).join(seen, key)
    mean = F.round(F.when((F.col("replicate") < bootstraps) & (F.col("n") > 0), F.col("total") / F.col("n")), 12)
    far = (F.col("replicate") < flips) & (F.abs(F.col("flipped") / F.col("rows")) >= F.abs("mean") - EQUAL)
    out = sums.groupBy(*key).agg(F.first("rows").alias("rows"), F.first("mean").alias("mean"), F.percentile(mean, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count_if(far).alias("far"))
    end = lambda i: F.when(F.col("rows") == 1, F.col("mean")).otherwise(F.col("ci")[i])
    return out.select(*key, end(0).alias("ci_low"), end(1).alias("ci_high"), F.when(F.abs("mean") < EQUAL, 1.0).otherwise((F.col("far") + 1) / (flips + 1)).alias("p_value"))
