"""Bouts folded in waves against bouts folded one by one; searches that derive their bouts once."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest

from boutlens.functions.odds import RATING
from boutlens.operators import graph, rating, search
from boutlens.plans import ratings
from tests.conftest import SF

KINDS = {"component": pa.int64(), "day": pa.int32(), "division": pa.string(), "fighter_a": pa.int64(), "fighter_b": pa.int64(), "winner": pa.int64()}


def folded(batch, rows, config=RATING):
    """Every row's values of both sides, folded in batches of ``rows``, and the waves that it took."""
    fold, out, waves = rating._Fold(config), {}, 0
    for lo in range(0, batch.num_rows, rows):
        for i, a, b, p in fold.run(batch.slice(lo, rows), lambda i: np.ones((len(i), 1))):
            waves += 1
            out |= {lo + k: [v.reshape(len(i), -1)[j].tolist() for v in (*a, *b, p)] for j, k in enumerate(i)}
    return out, waves


def test_waves_equal_single_bouts():
    """Also unknown fighters and divisions, bouts against oneself, several components and configurations."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        c = i // 300
        a, b = (rng.choice([None, *range(10 * c, 10 * c + 9)]) for _ in "ab")
        rows.append((c, i % 300 * 11, rng.choice(["Lightweight", "Welterweight", "Catch Weight", None]), a, b, rng.choice([a, b, None])))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS.values())], list(KINDS))
    many = {k: np.array([v, v * 1.25]) for k, v in RATING.items()}
    for config in (RATING, many):
        assert folded(batch, 900, config)[0] == folded(batch, 1, config)[0] == folded(batch, 77, config)[0]


def test_bouts_that_share_no_fighter_are_one_wave():
    n = 500
    columns = [[0] * n, list(range(n)), ["Lightweight"] * n, list(range(n)), list(range(n, 2 * n)), list(range(n))]
    out, waves = folded(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS.values())], list(KINDS)), n)
    assert waves == 1 and len(out) == n


def test_joint_search_derives_bouts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rating, "components", lambda edges: seen.append(1) or graph.components(edges))
    sweeps = {"margin": [{"ko": k} for k in (1.2, 1.6)], "transfer": [{"transfer": x} for x in (0.5, 0.7)]}
    assert search.joint(ratings._detailed(spark, SF), sweeps, datetime.date(2000, 1, 1), 2).count() == 4
    assert len(seen) == 1


def test_groups_of_configurations(spark, monkeypatch):
    """Configurations that are folded by tasks of their own score as they do together."""
    bouts = ratings._detailed(spark, SF)
    configs = [RATING | {"ko": 1 + i / 10} for i in range(5)]
    together = {r.config: r for r in rating.backtest(bouts, configs, datetime.date(2000, 1, 1)).collect()}
    monkeypatch.setattr(rating, "CONFIGS", 2)
    apart = {r.config: r for r in rating.backtest(bouts, configs, datetime.date(2000, 1, 1)).collect()}
    assert together.keys() == apart.keys() == set(range(5))
    for i in together:
        assert apart[i].n == together[i].n and apart[i].brier == pytest.approx(together[i].brier, abs=1e-12)


def test_forest_keeps_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 7), (900, 900)] + [(1, 2)] * 50
    df = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    thin = graph.forest(df)
    labels = lambda e: {r.node: r.component for r in graph.components(e).collect()}
    assert labels(thin) == labels(df) and thin.count() <= 200 + 1 + 4


def test_before_equals_overall(spark):
    bouts = ratings._detailed(spark, SF)
    want = {(r.fight_id, r.fighter): r.before for r in rating.overall(bouts).collect()}
    rows = rating.before(bouts).collect()
    assert {(r.fight_id, x): v for r in rows for x, v in ((r.fighter_a, r.a), (r.fighter_b, r.b))} == want and len(want) == 2 * len(rows)


def test_calibration_folds_once_and_joins_no_ratings(spark, monkeypatch):
    """The gaps come out of the fold; joins are those that derive the bouts and label their components."""
    seen = []
    monkeypatch.setattr(rating, "components", lambda edges: seen.append(1) or graph.components(edges))
    plan = ratings.elo_calibration(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and plan.count("MapInArrow") == 1 and plan.count("Join ") == 1
