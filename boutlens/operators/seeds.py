"""Boosted trees of many seeds grown together: one job a level, whatever the number of seeds.

Columns are binned once by their quantiles. Every seed draws its own bootstrap weights (Poisson, by a hash of the row's
key and the seed) and its own columns for each tree. A level of all seeds' trees is one pass over the rows: each task
sums gradients and hessians of the logistic loss by seed, leaf, column and bin in one array, the arrays are added up by
column, and the best split of each leaf is all that comes to the driver. The rows carry a margin for each seed,
brought up to date and written once a tree. A seed grown alone gives the same trees as among others.

Missing values have a bin of their own, which goes left or right with the bins below or above it. Rows without an
outcome take no part in the fit. Ties between splits go to the first column and the lowest bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.operators.graph import checkpointed

BINS = 32


@dataclass(frozen=True)
class Params:
    trees: int = 20
    depth: int = 3
    rate: float = 0.1
    ridge: float = 1.0
    least_weight: float = 5.0
    columns: float = 0.8


@dataclass
class Forest:
    """What was learnt: edges of the bins by column, and for each tree and seed its splits and leaves."""

    columns: list[str]
    edges: list[np.ndarray]
    seeds: list[int]
    params: Params
    #: for each tree (seed, node, (column, bin)), column -1 where a node isn't split
    splits: list[np.ndarray] = field(default_factory=list)
    #: for each tree (seed, leaf of the last level)
    leaves: list[np.ndarray] = field(default_factory=list)


def _edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10 * bins)).alias(c) for c in columns)).first()
    return [np.unique(np.array(row[c] if row[c] is not None else [], float)) for c in columns]


def _codes(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix (row, column): 0 for a missing value."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(e, values[:, j], side="left"))
    return out


def _draw(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) by a hash of keys and a salt."""
    h = (key.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return ((h ^ h >> np.uint64(29)) >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(10)])


def weights(key: np.ndarray, seeds: list[int]) -> np.ndarray:
    """Bootstrap weights (row, seed): how often each row is drawn for each seed."""
    return np.stack([np.searchsorted(_POISSON, _draw(key, 2 * s + 1)) for s in seeds], axis=1).astype(float)


def _leaf(codes: np.ndarray, splits: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels of one tree's splits (node, (column, bin)), numbered inside the level."""
    at = np.zeros(len(codes), np.int64)
    for level in range(depth):
        own = splits[(1 << level) - 1 + at]
        right = (own[:, 0] >= 0) & (codes[np.arange(len(codes)), own[:, 0]] > own[:, 1])
        at = 2 * at + right
    return at


def _columns_of(seed: int, tree: int, n: int, share: float) -> np.ndarray:
    rng = np.random.default_rng([seed, tree])
    return np.sort(rng.choice(n, max(1, round(share * n)), replace=False))


def fit(df: DataFrame, columns: list[str], seeds: list[int], key: str = "fight_id", y: str = "y", params: Params = Params(), bins: int = BINS) -> Forest:
    """Trees of all ``seeds`` on the rows of ``df``."""
    rows = df.filter(F.col(y).isNotNull())
    forest = Forest(columns, _edges(rows, columns, bins), list(seeds), params)
    edges, s_n, c_n = forest.edges, len(seeds), len(columns)
    plain = rows.select(F.xxhash64(key).alias("key"), F.col(y).cast("double").alias("y"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))

    def coded(batches):
        for b in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], float).reshape(-1, c_n)
            code = _codes(x, edges)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([np.zeros(s_n).tobytes()] * len(code), pa.binary())], ["key", "y", "x", "margin"])

    held = checkpointed(plain.mapInArrow(coded, "key long, y double, x binary, margin binary"))

    def parts(b):
        code = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, c_n)
        margin = np.frombuffer(b"".join(b.column("margin").to_pylist())).reshape(-1, s_n)
        return b.column("key").to_numpy(), b.column("y").to_numpy(), code, margin

    wide = bins + 1
    for tree in range(params.trees):
        splits = np.full((s_n, (1 << params.depth) - 1, 2), -1, np.int64)
        allowed = [_columns_of(s, tree, c_n, params.columns) for s in seeds]
        for level in range(params.depth + 1):
            nodes = 1 << level

            def sums(batches, splits=splits.copy(), level=level, nodes=nodes):
                total = np.zeros((c_n, s_n, nodes, wide, 2))
                for b in batches:
                    if not b.num_rows:
                        continue
                    k, target, code, margin = parts(b)
                    w = weights(k, seeds)
                    p = 1 / (1 + np.exp(-margin))
                    for s in range(s_n):
                        at = _leaf(code, splits[s], level)
                        for kind, v in enumerate((w[:, s] * (target - p[:, s]), w[:, s] * p[:, s] * (1 - p[:, s]))):
                            for c in allowed[s] if level < params.depth else allowed[s][:1]:
                                total[c, s, :, :, kind] += np.bincount(at * wide + code[:, c], v, nodes * wide).reshape(nodes, wide)
                yield pa.RecordBatch.from_arrays([pa.array(range(c_n)), pa.array([t.tobytes() for t in total], pa.binary())], ["column", "sums"])

            def best(key, t):
                """A column's gain, bin, gradient and hessian for each seed and node."""
                total = sum(np.frombuffer(x) for x in sorted(t["sums"].to_pylist())).reshape(s_n, -1, wide, 2)
                left = np.cumsum(total, axis=2)
                whole = left[:, :, -1:, :]
                right = whole - left
                score = lambda x: x[..., 0] ** 2 / (x[..., 1] + params.ridge)
                gain = score(left) + score(right) - score(whole)
                gain[(np.minimum(left[..., 1], right[..., 1]) * 4 < params.least_weight)] = 0
                at = gain.argmax(axis=2)
                out = np.stack([np.take_along_axis(gain, at[:, :, None], 2)[:, :, 0], at, whole[:, :, 0, 0], whole[:, :, 0, 1]], axis=2)
                return pa.table({"column": [key[0].as_py()], "best": pa.array([out.tobytes()], pa.binary())})

            added = held.mapInArrow(sums, "column long, sums binary").groupBy("column").applyInArrow(best, "column long, best binary")
            found = {r["column"]: np.frombuffer(r["best"]).reshape(s_n, nodes, 4) for r in added.collect()}  # four numbers a column, seed and node
            for s in range(s_n):
                for node in range(nodes):
                    if level == params.depth:
                        continue
                    gain, column = max(((found[c][s, node, 0], -c) for c in allowed[s].tolist()), default=(0, 0))
                    if gain > 1e-9:
                        splits[s, nodes - 1 + node] = (-column, found[-column][s, node, 1])
            if level == params.depth:
                first = [int(a[0]) for a in allowed]
                g, h = (np.stack([found[first[s]][s, :, k] for s in range(s_n)]) for k in (2, 3))
                leaves = params.rate * g / (h + params.ridge)
        forest.splits.append(splits)
        forest.leaves.append(leaves)

        def moved(batches, splits=splits, leaves=leaves):
            for b in batches:
                if b.num_rows:
                    _, _, code, margin = parts(b)
                    new = margin + np.stack([leaves[s][_leaf(code, splits[s], params.depth)] for s in range(s_n)], axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), b.column("x"), pa.array([r.tobytes() for r in new], pa.binary())], ["key", "y", "x", "margin"])

        if tree + 1 < params.trees:
            held = checkpointed(held.mapInArrow(moved, "key long, y double, x binary, margin binary"))
    return forest


def probabilities(df: DataFrame, forest: Forest) -> DataFrame:
    """``df`` with ``probabilities``, one of each seed in the order of the forest's."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    def run(batches):
        f = shared.value
        for b in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in b.column("__x").to_pylist()], float).reshape(-1, len(f.columns))
            code = _codes(x, f.edges)
            margin = np.zeros((len(code), len(f.seeds)))
            for splits, leaves in zip(f.splits, f.leaves):
                for s in range(len(f.seeds)):
                    margin[:, s] += leaves[s][_leaf(code, splits[s], f.params.depth)]
            p = 1 / (1 + np.exp(-margin))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "__x"), pa.array(list(p), pa.list_(pa.float64()))], [*(c for c in b.schema.names if c != "__x"), "probabilities"])

    schema = StructType([*df.schema.fields, StructField("probabilities", ArrayType(DoubleType()))])
    return df.withColumn("__x", F.array(*(F.col(c).cast("double") for c in forest.columns))).mapInArrow(run, schema)


def noise_floor(scored: DataFrame, by: str, seeds: list[int], y: str = "y") -> DataFrame:
    """(by, seeds, median and sample deviation of Brier score and accuracy over the seeds, brier_max, accuracy_min).

    The limits are a median less or plus one deviation, as a gate takes them: what a better model must beat.
    """
    each = scored.filter(F.col(y).isNotNull()).select(by, F.col(y).cast("double").alias("y"), F.posexplode("probabilities").alias("seed", "p"))
    metrics = each.groupBy(by, "seed").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"))
    out = metrics.groupBy(by).agg(
        F.count("*").alias("seeds"), F.median("brier").alias("median_brier"), F.median("accuracy").alias("median_accuracy"),
        F.coalesce(F.stddev_samp("brier"), F.lit(0.0)).alias("spread_brier"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("spread_accuracy"),
    )
    return out.withColumns({"brier_max": F.round(F.col("median_brier") - F.col("spread_brier"), 4), "accuracy_min": F.round(F.col("median_accuracy") + F.col("spread_accuracy"), 4)})
