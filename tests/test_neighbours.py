"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.operators import neighbours
from tests.test_queries import compare


@pytest.mark.parametrize("centroids,part,k", [(512, 8192, 10), (7, 20, 3), (1, 50, 5), (40, 3, 400)])
def test_brute_force(spark, centroids, part, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 8)) * 3
    v = centres[rng.integers(0, 6, 260)] + rng.normal(size=(260, 8)) * 0.3
    v[200:240] = v[0]  # copies: ties by id
    rows = [(i, [float(x) for x in v[i]]) for i in range(260)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [None, 1.0]), (None, [1.0] * 8), (905, [2.5])]
    got = neighbours.nearest(spark.createDataFrame(rows + odd, "k long, e array<double>"), "k", "e", k, centroids, part).collect()
    held = {i: np.array(x) for i, x in rows} | {905: np.array([2.5] + [0.0] * 7)}
    ids = np.array(sorted(held))
    m = np.array([held[i] / np.linalg.norm(held[i]) for i in ids])
    near = m @ m.T
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    assert sorted(by) == ids.tolist()
    for row, i in enumerate(ids):
        want = sorted(np.delete(near[row], row), reverse=True)[:k]
        mine = sorted(by[i])
        assert [x[0] for x in mine] == list(range(1, len(want) + 1)) and i not in {x[1] for x in mine} and len({x[1] for x in mine}) == len(want)
        assert np.allclose([x[2] for x in mine], want, atol=1e-9)
        assert all(abs(s - near[row, np.searchsorted(ids, o)]) < 1e-9 for _, o, s in mine)


def test_bounds_leave_clusters_out(spark, monkeypatch):
    """Separate clusters aren't compared with each other."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.eye(20)[i % 4] * 5 + rng.normal(size=20) * 0.01]) for i in range(800)]
    asked = []
    whole = neighbours._searched
    monkeypatch.setattr(neighbours, "_searched", lambda a, h, k, d: asked.append(a) or whole(a, h, k, d))
    out = neighbours.nearest(spark.createDataFrame(rows, "k long, e array<double>"), "k", "e", 5)
    assert out.filter(F.col("id") % 4 != F.col("other") % 4).isEmpty() and out.count() == 4000
    assert asked[1].count() < 800 * 12


def test_none(spark):
    assert neighbours.nearest(spark.createDataFrame([], "k long, e array<float>"), "k", "e").count() == 0


def test_query(spark):
    compare(spark, "nearest_ten", "/root/testdata/sf0.01")
