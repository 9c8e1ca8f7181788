"""Bootstrap intervals against an independent version, and their invariants on larger inputs."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.operators import resampling
from boutlens.plans.catalog import QUERIES
from tests.conftest import SF


def brute(values, level, resamples, rng):
    """BCa by its definition: every replicate drawn row by row, every row left out once."""
    values = np.array(values)
    n, normal = len(values), NormalDist()
    means = np.array([values[rng.integers(0, n, n)].mean() for _ in range(resamples)])
    z0 = normal.inv_cdf((np.mean(means < values.mean()) + np.mean(means <= values.mean())) / 2)
    left = np.array([np.delete(values, i).mean() for i in range(n)])
    d = left.mean() - left
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    at = [normal.cdf(z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q)))) for q in ((1 - level) / 2, (1 + level) / 2)]
    return np.quantile(means, at), a


def test_small_slices_against_brute_force(spark):
    rng = np.random.default_rng(3)
    slices = {"skewed": (rng.random(120) ** 4).round(6), "even": rng.random(60).round(6), "bits": (rng.random(90) < 0.2).astype(float), "two": np.array([0.1, 0.9])}
    rows = [(s, float(v)) for s, values in slices.items() for v in values] + [("same", 0.5)] * 9 + [("one", 0.3), ("even", None), (None, 0.1), (None, 0.7), (None, 0.2)]
    df = spark.createDataFrame(rows, "slice string, v double")
    raw = {r.slice: r for r in resampling.bootstrap_means(df, ["slice"], "v").collect()}
    got = {r.slice: r for r in resampling.intervals(df, ["slice"], "v").collect()}
    assert set(got) == {*slices, "same", "one", None}
    for s, values in slices.items():
        want, a = brute(values, 0.68, 9999, rng)
        means = np.frombuffer(raw[s].sums) / raw[s].n
        assert raw[s].n == len(values) and len(means) == 9999 and raw[s].acceleration == pytest.approx(a, abs=1e-9)
        # the spread of the replicates is that of a mean of draws with replacement
        assert means.std() == pytest.approx(values.std() / np.sqrt(len(values)), rel=0.03) and means.mean() == pytest.approx(values.mean(), abs=4 * means.std() / 99)
        if len(values) > 10:
            width = want[1] - want[0]
            assert got[s].low == pytest.approx(want[0], abs=0.06 * width) and got[s].high == pytest.approx(want[1], abs=0.06 * width)
    assert got["same"].low is None and got["one"].low is None and got["one"].n == 1


def test_the_same_method_at_any_size(spark):
    """Chunks of any size give resamples of all rows: widths agree, also beyond the sizes that one task would hold."""
    df = spark.range(60000).select(F.lit("s").alias("slice"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 5000.0).alias("v"))
    exact = df.agg(F.stddev_pop("v")).first()[0] / np.sqrt(60000)
    for chunk in (64, 1 << 20):
        r = resampling.intervals(df, ["slice"], "v", resamples=2000, chunk=chunk).first()
        assert r.n == 60000 and r.high - r.low == pytest.approx(2 * exact * NormalDist().inv_cdf(0.84), rel=0.08)
    # partitions of the input don't matter
    one, two = (resampling.intervals(d, ["slice"], "v", resamples=500).first() for d in (df, df.repartition(13)))
    assert (one.low, one.high) == (two.low, two.high) and one["mean"] == pytest.approx(two["mean"])


def test_bins(spark):
    rng = np.random.default_rng(1)
    rows = [("s", float(p), int(rng.random() < p)) for p in rng.random(600)] + [("s", 1.0, 1), ("s", 0.1, 0), ("t", 0.35, 1)] + [("u", 0.55, 1)] * 12
    got = {(r.slice, r.bin): r for r in resampling.bin_intervals(spark.createDataFrame(rows, "slice string, p double, y int"), ["slice"]).collect()}
    for b in range(10):
        own = [y for s, p, y in rows if s == "s" and min(int(np.floor(p * 10)), 9) == b]
        r = got["s", b]
        assert r.n == len(own) and r.rate == pytest.approx(np.mean(own))
        draws = rng.binomial(len(own), np.mean(own), 20000) / len(own)
        assert r.low == pytest.approx(np.quantile(draws, 0.025), abs=2.1 / len(own)) and r.high == pytest.approx(np.quantile(draws, 0.975), abs=2.1 / len(own))
    assert got["t", 3].low is None and (got["u", 5].low, got["u", 5].high) == (1.0, 1.0)


def test_queries(spark):
    for name, keys in (("bootstrap_ci", 3), ("bootstrap_accuracy_ci", 3), ("bin_intervals", 30)):
        rows = QUERIES[name](spark, SF).collect()
        assert 0 < len(rows) <= keys
        if name != "bin_intervals":
            assert all(r.half is not None and 0 < r.half < 0.2 for r in rows)
        else:
            assert all(r.low is None or r.low <= r.rate <= r.high for r in rows)
