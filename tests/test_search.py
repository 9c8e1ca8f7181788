"""Staged searches against the single evaluations that they are made of."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.functions.odds import RATING
from boutlens.operators import assembly, matching, rating, search
from boutlens.plans import base, ratings
from boutlens.plans.bouts import bouts
from boutlens.plans.catalog import QUERIES
from tests.conftest import SF

SPLIT = datetime.date(2000, 1, 1)


def brier(spark, changes):
    """Each configuration by itself."""
    return [rating.backtest(ratings._detailed(spark, SF), [RATING | c], SPLIT).first()["brier"] for c in changes]


def test_joint(spark):
    sweeps = {"margin": [{"ko": k} for k in (1.2, 1.6, 1.9)], "transfer": [{"transfer": x} for x in (0.5, 0.7, 1.0)]}
    best = search.best_of_sweeps(ratings._detailed(spark, SF), sweeps, SPLIT, 2)
    for name, changes in sweeps.items():
        alone = brier(spark, changes)
        assert best[name] == [changes[i] for i in np.argsort(alone, kind="stable")[:2]]
    out = search.joint(ratings._detailed(spark, SF), sweeps, SPLIT, 2).orderBy("place").collect()
    combined = {str(sorted((m | t).items())): m | t for m in best["margin"] for t in best["transfer"]}
    assert [r.place for r in out] == [1, 2, 3, 4] and {r.changed for r in out} == set(combined)
    assert [r.brier for r in out] == sorted(r.brier for r in out)
    for r, v in zip(out, brier(spark, [combined[r.changed] for r in out])):
        assert r.brier == pytest.approx(v, abs=1e-12)
    assert QUERIES["elo_joint_search"](spark, SF).count() == 27


def test_half_lives(spark):
    """The weighted means by a loop, the model by gradient descent in numpy."""
    got = {r.half_life: r for r in QUERIES["half_life_search"](spark, SF).collect()}
    assert sorted(got) == [2, 3, 4, 5] and got[3].alpha == pytest.approx(0.2063, abs=1e-4)
    own = base.stats(spark, SF).withColumns({"total_landed": F.col("landed") + 3 * F.col("td_attempted"), "sub_attempts": F.col("td_attempted") - F.col("td_landed")})
    state, held = {}, {}
    for r in assembly.single_rates(own).orderBy("event_date", "fight_id").collect():
        means = state.setdefault(r.fighter, {})
        if means:
            held[r.fight_id, r.fighter] = [means.get(c) or 0.0 for c in assembly.RATES]
        means["any"] = 1
        for c in assembly.RATES:
            x = r[f"one_{c}"]
            if x is not None:
                means[c] = x if means.get(c) is None else means[c] * (1 - got[3].alpha) + x * got[3].alpha
    rows = [(r.event_date, np.subtract(held[r.fight_id, r.fighter_a], held[r.fight_id, r.fighter_b]), r.winner == r.fighter_a) for r in bouts(spark, SF).filter("winner is not null").collect() if (r.fight_id, r.fighter_a) in held and (r.fight_id, r.fighter_b) in held]
    x, y = np.array([v for d, v, _ in rows if d < SPLIT]), np.array([w for d, _, w in rows if d < SPLIT], float)
    late = [(v, w) for d, v, w in rows if d >= SPLIT]
    assert got[3].n == len(late) > 50
    a, w = np.c_[x, np.ones(len(x))], np.zeros(9)
    ridge = np.diag([1.0] * 8 + [0.0])
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
    p = 1 / (1 + np.exp(-np.c_[[v for v, _ in late], np.ones(len(late))] @ w))
    assert got[3].brier == pytest.approx(np.mean((p - [o for _, o in late]) ** 2), abs=2e-4)


def test_proportional_sample(spark):
    rows = spark.createDataFrame([(i, "big" if i < 70 else "mid" if i < 95 else "one" if i == 95 else None) for i in range(100)], "id long, s string")
    for k, want in ((10, {"big": 7, "mid": 3}), (20, {"big": 14, "mid": 5, None: 1}), (100, {"big": 70, "mid": 25, "one": 1, None: 4}), (500, {"big": 70, "mid": 25, "one": 1, None: 4}), (0, {})):
        got = matching.proportional_sample(rows, "id", k, 7, "s")
        assert got.columns == ["id", "s"] and {r.s: r["count"] for r in got.groupBy("s").count().collect()} == want
    assert sorted(map(tuple, matching.proportional_sample(rows, "id", 20, 7, "s").collect()), key=str) == sorted(map(tuple, matching.proportional_sample(rows.repartition(9), "id", 20, 7, "s").collect()), key=str)
