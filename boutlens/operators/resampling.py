"""Bootstrap of means at any size: one method, exact resampling, no slice gathered.

Rows fold to distinct values with counts. A slice's values are dealt out in chunks; how many of a replicate's draws
fall into each chunk is one multinomial draw, and within a chunk another one, so that a replicate is a resample of all
rows with replacement however they are dealt out. Chunks give a sum for each replicate; sums add up over chunks. The
acceleration of the BCa interval is that of the jackknife, taken from the slice's moments, which Spark merges.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES, LEVEL = 9999, 0.68
#: distinct values of a chunk, chunks of a slice at most, and numbers that a task draws at a time
CHUNK, MOST_CHUNKS, DRAWN = 2048, 1024, 1 << 19
_NORMAL = NormalDist()


def _generator(seed: int, *key) -> np.random.Generator:
    """Draws that depend on the seed and the key alone, not on where they are made."""
    words = [w for k in key for w in np.frombuffer(repr(k).encode().ljust(8 * -(-len(repr(k)) // 8)), "<u4").tolist()]
    return np.random.default_rng([seed, *words])


def bca_ends(means: np.ndarray, mean: float, acceleration: float, level: float) -> tuple[float, float]:
    """The bias-corrected and accelerated interval of replicate ``means`` around ``mean``."""
    share = ((means < mean).sum() + (means <= mean).sum()) / (2 * len(means))
    z0 = _NORMAL.inv_cdf(min(max(share, 1e-9), 1 - 1e-9))
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + _NORMAL.inv_cdf(q)
        ends.append(float(np.quantile(means, _NORMAL.cdf(z0 + z / (1 - acceleration * z)))))
    return ends[0], ends[1]


def bootstrap_means(df: DataFrame, by: list[str], value: str, resamples: int = RESAMPLES, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(by, n, mean, acceleration, means): every slice's replicate means, as doubles in a binary.

    Values are taken to six decimals; nulls take no part. ``acceleration`` is null where all values are equal.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.round(F.col(value).cast("double"), 6).alias("v"))
    # the acceleration of the jackknife of a mean: skewness / (6 sqrt(n))
    moments = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.skewness("v").alias("skew"), F.count_distinct("v").alias("different"))
    counts = rows.groupBy(*by, "v").agg(F.count("*").alias("n"))
    parts = moments.select(*by, F.least(F.ceil(F.col("different") / chunk), F.lit(MOST_CHUNKS)).alias("parts"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    both = on[0]
    for c in on[1:]:
        both = both & c
    dealt = counts.alias("l").join(parts.alias("r"), both).select(*(f"l.{c}" for c in by), "l.v", "l.n", F.pmod(F.xxhash64("l.v"), F.col("r.parts")).alias("chunk"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def split(key, t):
        """How many of each replicate's draws fall into each chunk."""
        t = t.sort_by("chunk")
        totals = t["n"].to_numpy()
        draws = _generator(seed, *(k.as_py() for k in key)).multinomial(int(totals.sum()), totals / totals.sum(), resamples)
        out = [pa.array([k.as_py()] * t.num_rows, t.schema.field(c).type) for c, k in zip(by, key)]
        return pa.Table.from_arrays([*out, t["chunk"], pa.array([d.astype("<i8").tobytes() for d in draws.T], pa.binary())], [*by, "chunk", "draws"])

    def within(key, t, d):
        """The sums of each replicate's draws from one chunk."""
        t = t.sort_by("v")
        v, n = t["v"].to_numpy(), t["n"].to_numpy()
        draws, share = np.frombuffer(d["draws"][0].as_py(), "<i8"), n / n.sum()
        rng = _generator(seed, *(k.as_py() for k in key))
        step = max(1, DRAWN // len(v))
        sums = np.concatenate([rng.multinomial(draws[i : i + step], share) @ v for i in range(0, resamples, step)])
        out = [pa.array([k.as_py()], t.schema.field(c).type) for c, k in zip(by, key)]
        return pa.Table.from_arrays([*out, pa.array([sums.tobytes()], pa.binary())], [*by, "sums"])

    totals = dealt.groupBy(*by, "chunk").agg(F.sum("n").alias("n"))
    draws = totals.groupBy(*by).applyInArrow(split, f"{keys}, chunk long, draws binary")
    sums = dealt.groupBy(*by, "chunk").cogroup(draws.groupBy(*by, "chunk")).applyInArrow(within, f"{keys}, sums binary")

    def summed(key, t):
        total = np.zeros(resamples)
        for s in t["sums"].to_pylist():  # in the order of their bytes: the same sum wherever they come from
            total += np.frombuffer(s)
        out = [pa.array([k.as_py()], t.schema.field(c).type) for c, k in zip(by, key)]
        return pa.Table.from_arrays([*out, pa.array([total.tobytes()], pa.binary())], [*by, "sums"])

    whole = sums.sortWithinPartitions(*by).groupBy(*by).applyInArrow(lambda key, t: summed(key, t.sort_by("sums")), f"{keys}, sums binary")
    met = moments.alias("l").join(whole.alias("r"), both)
    spread = F.when(F.col("l.different") > 1, F.col("l.skew") / (6 * F.sqrt(F.col("l.n"))))
    return met.select(*(f"l.{c}" for c in by), "l.n", "l.mean", spread.alias("acceleration"), F.col("r.sums").alias("sums"))


def intervals(df: DataFrame, by: list[str], value: str, level: float = LEVEL, resamples: int = RESAMPLES, seed: int = 42, method: str = "bca", least: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(by, n, mean, low, high): the interval of each slice's mean by ``method``, bca or percentile.

    Slices of fewer than ``least`` rows have none, nor has one of equal values by bca; by percentile it is that value.
    """
    if method not in ("bca", "percentile"):
        raise ValueError(f"unknown method {method!r}")
    met = bootstrap_means(df, by, value, resamples, seed, chunk)
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def run(batches):
        for b in batches:
            low, high = [], []
            for n, mean, acceleration, sums in zip(*(b.column(c).to_pylist() for c in ("n", "mean", "acceleration", "sums"))):
                means, ends = np.frombuffer(sums) / n, (None, None)
                if n >= least and method == "percentile":
                    ends = tuple(float(x) for x in np.quantile(means, [(1 - level) / 2, (1 + level) / 2]))
                elif n >= least and acceleration is not None:
                    ends = bca_ends(means, mean, acceleration, level)
                low.append(ends[0])
                high.append(ends[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*by, "n", "mean")), pa.array(low, pa.float64()), pa.array(high, pa.float64())], [*by, "n", "mean", "low", "high"])

    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, mean double, low double, high double")


def bin_intervals(df: DataFrame, by: list[str], bins: int = 10, least: int = 10, p: str = "p", y: str = "y", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(by, bin, n, mean_p, rate, low, high): the observed rate of each bin of scores and its 95 % percentile interval.

    Bins are closed on the left, the last one on both sides; with fewer than ``least`` rows there is no interval.
    """
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    marked = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", at)
    ends = intervals(marked, [*by, "bin"], y, 0.95, resamples, seed, "percentile", least)
    means = marked.groupBy(*by, "bin").agg(F.avg(p).alias("mean_p"))
    return means.join(ends, [*by, "bin"]).select(*by, "bin", "n", "mean_p", F.col("mean").alias("rate"), "low", "high")
