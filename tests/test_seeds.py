"""Trees of many seeds against a version that grows one tree after another in loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.operators import seeds
from boutlens.plans.catalog import QUERIES
from tests.conftest import SF

PARAMS = seeds.Params(trees=3, depth=2, rate=0.3, least_weight=2.0, columns=0.67)
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=400) > 0.3).astype(int)
    data = [(i, *(None if rng.random() < 0.1 else float(v) for v in x[i]), int(y[i]) if i % 50 else None) for i in range(400)]
    return spark.createDataFrame(data, "fight_id long, a double, b double, c double, y int").repartition(5)


def grown(df, seed):
    """One seed's trees, grown by sums over rows."""
    held = df.filter("y is not null").withColumn("key", F.xxhash64("fight_id")).toPandas()
    edges = seeds._edges(df.filter("y is not null"), COLUMNS, seeds.BINS)
    code = seeds._codes(held[COLUMNS].to_numpy(float), edges).astype(int)
    w, y, margin = seeds.weights(held.key.to_numpy(), [seed])[:, 0], held.y.to_numpy(float), np.zeros(len(held))
    trees = []
    for t in range(PARAMS.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        at, splits = np.zeros(len(held), int), []
        for level in range(PARAMS.depth):
            new = 2 * at
            for node in range(1 << level):
                own = at == node
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + PARAMS.ridge)
                best = (1e-9, -1, -1)
                for c in seeds._columns_of(seed, t, 3, PARAMS.columns).tolist():
                    for b in range(seeds.BINS + 1):
                        left, right = own & (code[:, c] <= b), own & (code[:, c] > b)
                        if min(h[left].sum(), h[right].sum()) * 4 < PARAMS.least_weight:
                            continue
                        gain = score(left) + score(right) - score(own)
                        if gain > best[0] + 1e-9:
                            best = (gain, c, b)
                splits.append(best[1:])
                if best[1] >= 0:
                    new += own & (code[:, best[1]] > best[2])
            at = new
        leaves = np.array([PARAMS.rate * g[at == k].sum() / (h[at == k].sum() + PARAMS.ridge) for k in range(1 << PARAMS.depth)])
        margin = margin + leaves[at]
        trees.append((splits, leaves))
    return trees, {int(k): 1 / (1 + np.exp(-m)) for k, m in zip(held.fight_id, margin)}


def test_seeds_together_and_alone(spark, rows):
    chosen = [3, 4, 11]
    forest = seeds.fit(rows, COLUMNS, chosen, params=PARAMS)
    scored = {r.fight_id: r.probabilities for r in seeds.probabilities(rows, forest).collect()}
    assert len(scored) == 400
    for n, s in enumerate(chosen):
        want, p = grown(rows, s)
        for t, (splits, leaves) in enumerate(want):
            assert [tuple(x) for x in forest.splits[t][n].tolist()] == [tuple(map(int, x)) for x in splits]
            assert np.allclose(forest.leaves[t][n], leaves)
        assert all(abs(scored[i][n] - v) < 1e-9 for i, v in p.items())
    alone = seeds.fit(rows, COLUMNS, [4], params=PARAMS)
    assert all((a[1] == b[0]).all() for a, b in zip(forest.splits, alone.splits)) and all(np.allclose(a[1], b[0]) for a, b in zip(forest.leaves, alone.leaves))
    assert any((a[0] != a[1]).any() for a in forest.splits)


def test_learning_and_noise_floor(spark, rows):
    chosen = list(range(6))
    forest = seeds.fit(rows, COLUMNS, chosen, params=seeds.Params(trees=6, depth=2, rate=0.3))
    scored = seeds.probabilities(rows.withColumn("slice", F.lit("s")), forest)
    r = seeds.noise_floor(scored, "slice", chosen).first()
    each = scored.filter("y is not null").toPandas()
    brier = [np.mean([(p[s] - y) ** 2 for p, y in zip(each.probabilities, each.y)]) for s in chosen]
    assert r.median_brier == pytest.approx(np.median(brier)) and r.spread_brier == pytest.approx(np.std(brier, ddof=1)) and r.spread_brier > 0
    assert r.median_brier < 0.23 and r.median_accuracy > 0.6 and r.brier_max == round(r.median_brier - r.spread_brier, 4) and r.seeds == 6


def test_query(spark):
    r = QUERIES["seed_noise_floor"](spark, SF).first()
    assert r.year == 2001 and r.seeds == 10 and 0.1 < r.median_brier < 0.35 and r.spread_brier > 0
