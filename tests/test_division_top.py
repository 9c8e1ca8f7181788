from boutlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_each_division_has_its_own_limit(spark):
    got = QUERIES["division_top15"](spark, SF).toPandas()
    all_divisions = {r.division for r in QUERIES["distinct_pair_count"](spark, SF).collect()}
    assert set(got.division) == all_divisions
    assert all(sorted(g.place) == list(range(1, 16)) for _, g in got.groupby("division"))
