"""Ranks as of many days, solved some at a time over streamed edges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from boutlens.operators import graph
from tests.test_ratings import plain_rank

D = datetime.date


@pytest.fixture(scope="module")
def made(spark):
    """Edges of 40 years, some nodes known late; the days lie decades apart."""
    rng = random.Random(8)
    edges = {}
    for _ in range(300):
        a, b = rng.sample(range(50), 2)
        edges.setdefault((a * 7, b * 7), (a * 7, b * 7, rng.choice([0.8, 1.0, 2.3]), D(1980, 1, 1) + datetime.timedelta(rng.randrange(14600))))
    return list(edges.values()), spark.createDataFrame(list(edges.values()), "src long, dst long, weight double, earliest date")


@pytest.mark.parametrize("decay", [None, graph.DECAY])
def test_nodes_asked_for(spark, made, decay):
    """Only they come out, however often they are asked for; unknown ones and null don't."""
    edges, df = made
    rng = random.Random(3)
    asked = [(D(1979, 1, 1) + datetime.timedelta(rng.randrange(15500)), rng.choice([None, 1, *range(0, 350, 7)])) for _ in range(150)]
    rows = graph.pagerank_asof(df, spark.createDataFrame(asked * 2, "as_of date, node long"), decay, 100).collect()
    got = {(r.as_of, r.node): (r["rank"], r.sos) for r in rows}
    want = {}
    for day, node in asked:
        known = [(s, d, w * (decay ** (day - e).days if decay else 1)) for s, d, w, e in edges if e < day]
        rank = plain_rank(known) if known else {}
        if node in rank:
            beaten = [rank[s] for s, d, _ in known if d == node]
            want[day, node] = rank[node], sum(beaten) / len(beaten) if beaten else None
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 50
    for k, (rank, sos) in want.items():
        assert got[k][0] == pytest.approx(rank, abs=1e-9) and (got[k][1] is None if sos is None else got[k][1] == pytest.approx(sos))


def test_edges_are_not_multiplied_by_days(spark, made):
    """However many edges a task may hold, no join meets edges and days."""
    plan = graph.pagerank_asof(made[1], spark.range(500).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("as_of")), None, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "earliest" not in plan and plan.count("MapInArrow") == 1


def test_no_edges(spark, made):
    assert graph.pagerank_asof(made[1].filter("false"), spark.createDataFrame([(D(2000, 1, 1),)], "as_of date")).isEmpty()
