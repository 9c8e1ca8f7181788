"""The read surface on a small store."""

import datetime

import pytest

from boutlens import api, schemas

D = datetime.date


@pytest.fixture(scope="module")
def store(spark):
    people = [(1, "Jon Jones", "ufcstats", 76.0, 84.5, "Orthodox", D(1987, 7, 19)), (2, "Anderson Silva", "ufcstats", 74.0, 77.5, "Southpaw", D(1975, 4, 14)), (3, "jon jones", "sherdog", None, None, None, None), (4, "Antonio Silva", "sherdog", 76.0, 82.0, None, None)]
    fighters = spark.createDataFrame(people, "id long, name string, source string, height double, reach double, stance string, born date")
    aliases = spark.createDataFrame([(1, "Bones"), (2, "The Spider"), (2, "Spider")], "id long, alias string")
    bouts = [(10, D(2010, 1, 1), "Light Heavyweight", 1, 2, 1, "Decision"), (11, D(2011, 1, 1), "Light Heavyweight", 1, 4, None, "Decision"), (12, D(2012, 1, 1), "Middleweight", 2, 4, 2, "KO/TKO"), (13, D(2013, 1, 1), "Light Heavyweight", 2, 1, 1, "DQ")]
    snaps = []
    for f, fight, div, shown, day in ((1, 10, "Light Heavyweight", 1510.0, D(2010, 1, 1)), (1, 13, "Light Heavyweight", 1540.0, D(2013, 1, 1)), (2, 10, "Light Heavyweight", 1490.0, D(2010, 1, 1)), (2, 13, "Light Heavyweight", 1470.0, D(2013, 1, 1)), (2, 12, "Middleweight", 1520.0, D(2012, 1, 1)), (3, 99, "Light Heavyweight", 1600.0, D(2009, 1, 1)), (4, 11, "Light Heavyweight", 1500.0, D(2011, 1, 1))):
        snaps += [(f, fight, div, t, 1500.0, shown, shown + x, day) for t, x in (("overall", 0.0), ("striking", 20.0), ("grappling", -20.0))]
    snapshots = spark.createDataFrame(snaps, "fighter long, fight_id long, division string, elo_type string, before double, after double, shown double, event_date date")
    features = spark.createDataFrame([(1, 10, D(2010, 1, 1), 4.0, None, "striker"), (1, 13, D(2013, 1, 1), 5.0, 6.0, "striker"), (2, 13, D(2013, 1, 1), 3.0, None, "balanced")], "fighter long, fight_id long, as_of date, td_rate double, td_rate_ewma double, style_tag string")
    return api.Store(fighters, aliases, bouts=spark.createDataFrame(bouts, "fight_id long, event_date date, division string, fighter_a long, fighter_b long, winner long, method string"), snapshots=snapshots, features=features)


def test_search(store):
    assert [r.id for r in api.search_fighters(store, "SPIDER").collect()] == [2]
    assert {r.id for r in api.search_fighters(store, "silva").collect()} == {2, 4}
    assert {r.id for r in api.search_fighters(store, "jones").collect()} == {1, 3}


def test_detail_and_history(store):
    got = [tuple(r) for r in api.fighter_detail(store, 2).collect()]
    assert got == [(2, "Light Heavyweight", 1470.0, D(2013, 1, 1), 2, 0, 2), (2, "Middleweight", 1520.0, D(2012, 1, 1), 1, 1, 0)]
    assert [tuple(r)[4:] for r in api.fighter_detail(store, 1, "Light Heavyweight").collect()] == [(3, 2, 0)]
    assert [r.shown for r in api.elo_history(store, 1).collect()] == [1510.0, 1540.0]
    assert api.domain_ratings(store, 1).first() == (1560.0, 1520.0) and api.domain_ratings(store, 77).first() == (None, None)
    assert [r.division for r in api.divisions(store, 2).collect()] == ["Light Heavyweight", "Middleweight"]


def test_rankings_fold_names(store):
    """The trusted source's entry counts although another one is rated higher."""
    got = [(r.place, r.fighter, r.rating, r.bouts) for r in api.division_rankings(store, "Light Heavyweight").collect()]
    assert got == [(1, 1, 1540.0, 3), (2, 4, 1500.0, 2), (3, 2, 1470.0, 3)]
    assert len(api.division_rankings(store, "Light Heavyweight", 2).collect()) == 2
    assert {(r.fighter, r.division): r.overall for r in api.fighters_with_ratings(store).collect()}[2, "Middleweight"] == 1520.0
    assert api.resolve_division(store, "light heavy") == "Light Heavyweight" and api.resolve_division(store, "catch") is None


def test_matchup(store):
    r = api.build_matchup(store, "JON JONES", "anderson").first()
    assert (r.id_a, r.id_b, r.division, r.same_division, r.elo_diff, r.height_diff) == (1, 2, "Light Heavyweight", True, 70.0, 2.0)
    assert r.expected_a == pytest.approx(1 / (1 + 10 ** (-70 / 400))) and r.style_a == "striker" and (r.td_rate_a, r.td_rate_b) == (6.0, 3.0)
    r = api.build_matchup(store, "silva", "Jon Jones").first()
    assert r.id_a is None and r.id_b == 1


def test_inference_rows(spark, store):
    """Only what was known before the day; a newcomer starts at 1500."""
    pairs = spark.createDataFrame([(1, 2, D(2013, 1, 1)), (1, 2, D(2013, 1, 2)), (4, 77, D(2020, 1, 1))], "a long, b long, day date")
    got = {(r.a, r.day): r for r in api.inference_rows(store, pairs).collect()}
    first, second, third = got[1, D(2013, 1, 1)], got[1, D(2013, 1, 2)], got[4, D(2020, 1, 1)]
    assert first.elo_diff == 1510.0 - 1520.0 and first.td_rate_diff is None
    assert second.elo_diff == 1540.0 - 1470.0 and second.td_rate_diff == 2.0 and second.height_diff == 2.0
    assert third.elo_diff == 0.0 and third.elo_prob == 0.5 and third.reach_diff is None


def test_schemas(spark):
    rows = spark.createDataFrame([(1, 10, 1, 2, "3", None), (1, 10, 1, 1, "9", "x")], "id long, event_id long, fighter_a_id long, fighter_b_id long, num_rounds string, other string")
    table = schemas.conform(rows, schemas.FIGHTS)
    assert table.columns == schemas.FIGHTS.names and dict(table.dtypes)["num_rounds"] == "int"
    got = {r.rule: r.n for r in schemas.faults(table, schemas.FIGHTS, schemas.KEYS["fights"], schemas.CHECKS["fights"]).collect()}
    assert got["num_rounds"] == 1 and got["same_fighter"] == 1 and got["repeated key"] == 1 and got["null weight_class"] == 2 and got["null id"] == 0
