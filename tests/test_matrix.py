"""The whole matrix: its columns, its shuffles, missing rows, and histories folded in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from boutlens.operators import assembly, history, matrix
from boutlens.plans import assembled
from boutlens.plans.registry import QUERIES
from tests.conftest import SF
from tests.test_queries import compare


@pytest.mark.parametrize("name", ["feature_matrix_72", "feature_matrix_92"])
def test_matrix_at_ten_times_the_rows(spark, name):
    compare(spark, name, "/root/testdata/sf0.01")


def test_columns_in_their_order(spark):
    for name, width in (("feature_matrix_72", "v2.1-no-net"), ("feature_matrix_92", "v2.5-travel")):
        out = QUERIES[name](spark, SF)
        assert out.columns == ["fight_id", "event_date", "y", *matrix.feature_columns(width)]
    widths = {s: len(matrix.feature_columns(s)) for s in ("v1.0", "v2.1-no-net", "v2.2", "v2.5-travel", "no-odds")}
    assert widths == {"v1.0": 75, "v2.1-no-net": 72, "v2.2": 90, "v2.5-travel": 92, "no-odds": 67}
    assert matrix.feature_columns("v1.0")[:72] == matrix.feature_columns("v2.2")[:72] == matrix.feature_columns()
    with pytest.raises(ValueError, match="unknown feature set"):
        matrix.feature_columns("v9")


def small(spark):
    bouts = spark.createDataFrame(
        [(1, "d", 10, 20, 10), (2, "d", 10, 30, None), (3, "e", 20, 30, 30)], "fight_id long, division string, fighter_a long, fighter_b long, winner long"
    )
    one = spark.createDataFrame([(1, 10, 1.5, None), (1, 20, 1.0, 2.0), (3, 30, 7.0, 7.0)], "fight_id long, fighter long, x double, z double")
    two = spark.createDataFrame([(1, 20, "s"), (2, 30, "t"), (9, 10, "stray")], "fight_id long, fighter long, w string")
    more = spark.createDataFrame([(2, True)], "fight_id long, again boolean")
    return bouts, one, two, more


def test_blocks_come_together(spark):
    bouts, one, two, more = small(spark)
    met = assembly.together(bouts, [one, two], [more])
    got = {r.fight_id: r for r in met.collect()}
    assert sorted(got) == [1, 2, 3]
    sides = {r.fight_id: {r.side_a: r.a, r.side_b: r.b} for r in got.values()}
    assert (sides[1][10].x, sides[1][10].z, sides[1][10].w) == (1.5, None, None) and (sides[1][20].z, sides[1][20].w) == (2.0, "s")
    assert sides[2][30].w == "t" and sides[2][30].x is None and sides[2][10].w is None
    assert sides[3][20].x is None and sides[3][30].x == 7.0
    assert got[2].again is True and got[1].again is None and got[2].y is None
    assert all((r.y == 1) == (sides[r.fight_id] and r.side_a == {1: 10, 3: 30}[r.fight_id]) for r in got.values() if r.y is not None)


def test_blocks_move_once(spark):
    """Any number of blocks costs one exchange by bout, and no join."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bouts, one, two, more = small(spark)
        for blocks in ([one], [one, two, one.select("fight_id", "fighter", F.col("x").alias("v"))]):
            plan = assembly.together(bouts, blocks, [more])._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(fight_id") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_network_columns(spark):
    """The 75 columns end with the differences of rank, strength of schedule and debut; the first 72 are the same."""
    from boutlens.operators import graph
    from boutlens.plans.bouts import bouts, sides

    wide, plain = (assembled.feature_matrix(spark, SF, s).orderBy("fight_id").collect() for s in ("v1.0", "v2.1-no-net"))
    assert [r[: 3 + 72] for r in wide] == [tuple(r) for r in plain]
    b = bouts(spark, SF)
    ranks = graph.pagerank_asof(graph.edges(b), b.select(F.col("event_date").alias("as_of")).distinct(), graph.DECAY)
    own = {(r.fight_id, r.fighter): r for r in graph.network_features(sides(spark, SF).select("fight_id", "event_date", "fighter"), ranks).collect()}
    pairs = {r.fight_id: (r.a, r.b) for r in matrix.oriented(b).collect()}
    seen = 0
    for r in wide:
        a, z = (own[r.fight_id, s]["rank"] for s in pairs[r.fight_id])
        assert (r.pagerank_diff is None) == (a is None or z is None)
        if r.pagerank_diff is not None:
            seen += 1
            assert abs(r.pagerank_diff - (a - z)) < 1e-6
    assert seen > 100


def test_folded_histories(spark):
    """Against a loop, with nulls, ties of days and batches that cut histories."""
    rng = random.Random(2)
    rows = [(k, f"2000-01-{rng.randrange(1, 29):02d}", i, rng.choice([None, round(rng.random(), 3)]), rng.choice([None, 1, 2])) for i, k in enumerate(rng.choice([1, 1, 1, 2, 3, None]) for _ in range(400))]
    df = spark.createDataFrame(rows, "fighter long, event_date string, fight_id long, x double, z int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.fight_id: r for r in history.folded(df, {"ex": "x", "ez": "z"}, {"x3": ("x", 3)}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {}
    for k, _, i, x, z in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        xs, zs = state.setdefault(k, ([], []))

        def mean(values):
            m = None
            for v in values:
                m = v if m is None else m * (1 - 0.206) + v * 0.206
            return 0.0 if m is None else m

        assert got[i].ex == mean(xs) and got[i].ez == mean(zs)
        assert got[i].x3 == (sum(xs[-3:]) / 3 if len(xs) >= 3 else None)
        xs += [x] if x is not None else []
        zs += [float(z)] if z is not None else []
