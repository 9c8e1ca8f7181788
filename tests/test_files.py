"""Readers, parsers of pages and writers on small files."""

import datetime
import json

import pytest

from boutlens.functions import text
from boutlens.sinks import tables
from boutlens.sources import files, pages

D = datetime.date


def put(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_profiles(spark, tmp_path):
    path = put(tmp_path, "p.csv", ["fighter_name,Height,Weight,Reach,Stance,DOB,SLpM", "\"Jon Jones\",\"6' 4\"\"\",205 lbs.,\"84.5\"\"\",Orthodox,\"Jul 19, 1987\",4.3", "No One,--,--,--,,--,0"])
    got = files.profiles(spark, path).collect()
    assert [tuple(r) for r in got] == [("Jon Jones", 76.0, 84.5, "Orthodox", D(1987, 7, 19)), ("No One", None, None, None, None)]


def contest(tmp_path, **changes):
    base = {"R_fighter": "A", "B_fighter": "B", "R_KD": "1", "B_KD": "0", "win_by": "Decision - Split", "last_round": "3", "last_round_time": "5:00", "Format": "3 Rnd (5-5-5)", "Referee": "Herbert Dean",
            "date": "March 28, 2020", "location": "X, Y", "Fight_type": "Main Lightweight Title Bout", "Winner": "A"}
    for p in "RB":
        base |= {f"{p}_{c}": "69 of 101" for c in files.PAIRED} | {f"{p}_SUB_ATT": "2", f"{p}_REV": "0", f"{p}_CTRL": "3:15"}
    rows = [base | c for c in ({}, {"date": "NOT_A_DATE"}, {"Winner": "Red"}, {"Fight_type": "Exhibition"}, {"B_fighter": "A"}, *([changes] if changes else []))]
    return put(tmp_path, "c.csv", [";".join(base), *(";".join(r.values()) for r in rows)])


def test_contests(spark, tmp_path):
    bouts, rejected = files.contests(spark, contest(tmp_path))
    got = bouts.collect()
    assert len(got) == 2 and [r.winner for r in got] == ["A", None]
    r = got[0]
    assert (r.day, r.division, r.is_title, r.rounds, r.method, r.detail, r.referee, r.round_finished) == (D(2020, 3, 28), "Lightweight", True, 3, "Decision", "Split", "herb-dean", 3)
    assert sorted(x.reason for x in rejected.collect()) == ["no date", "same fighter twice", "unknown division"]
    stats = files.corner_stats(bouts).collect()
    assert len(stats) == 4 and all((s.sig_landed, s.sig_attempted, s.control) == (69, 101, 195) for s in stats)
    counts = tables.write_valid(bouts.select("day", "division"), rejected.select("reason"), str(tmp_path / "out"))
    assert counts == {"valid": 2, "rejected": 3}


def test_supplement(spark, tmp_path):
    row = ["A", "B", "2020-03-28", "Blue", "Lightweight", "TRUE", "5", "Overturned", "", "2.0", "1:30", "X", "180", "0", "Southpaw", "30", "175.3", "180", "", ""]
    bouts, fighters = files.supplement(spark, put(tmp_path, "s.csv", [",".join(files.SUPPLEMENT), ",".join(row)]))
    r = bouts.collect()[0]
    assert (r.winner, r.is_title, r.rounds, r.method, r.detail, r.round_finished) == ("B", True, 5, "Other", None, 2)
    got = {f.name: f for f in fighters.collect()}
    assert got["A"].height == 70.87 and got["A"].reach is None and got["A"].born == D(1990, 3, 29) and got["B"].born is None


def test_odds(spark, tmp_path):
    lines = ["fight_id,fighter_id,opening,closing_range_min,closing_range_max", "2020-01-01|a|b,a,-150,-200,-180", "2020-01-01|a|b,b,130,150,170", "2020-02-01|a|c,a,,-105,100", "soon|a|b,a,1,2,3", ",x,1,2,3"]
    sides, rejected = files.odds(spark, put(tmp_path, "o.csv", lines))
    assert sorted(r.reason for r in rejected.collect()) == ["no date", "no fight", "not two sides"]
    got = {r.fighter_id: r for r in files.fair_odds(sides).collect()}
    assert got["a"].opening_implied_prob == pytest.approx(0.6 / (0.6 + 100 / 230))
    assert got["a"].closing_implied_prob + got["b"].closing_implied_prob == pytest.approx(1)


def test_seeds(spark, tmp_path):
    assert files.seeds(spark, str(tmp_path / "none.csv")).count() == 0
    good = put(tmp_path, "g.csv", [",".join(files.SEED), "1,20,0.8,major", "2,0,0.0,none", "3,100,1.0,local"])
    assert {r.fighter_id: r.seed for r in files.seeds(spark, good).collect()} == {1: 1605.0, 2: 1400.0, 3: 1550.0}
    for line in ("1,,0.5,major", "1,3,0.5,grand"):
        with pytest.raises(Exception):
            files.seeds(spark, put(tmp_path, "b.csv", [",".join(files.SEED), line])).collect()
    assert files.first_existing(spark, str(tmp_path / "none.csv"), good) == good


def test_checked_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.with_sidecar(spark.range(3).selectExpr("id", "cast(id as double) as v"), path, str(tmp_path / "t.json"), {"sha": "x", "width": 13})
    schema = spark.createDataFrame([], "v double, id long").schema
    assert files.checked_parquet(spark, path, schema).columns == ["v", "id"]
    with pytest.raises(ValueError, match="missing"):
        files.checked_parquet(spark, path, spark.createDataFrame([], "w double, v int").schema)
    assert files.with_sidecar(spark, path, str(tmp_path / "t.json"), {"sha": "x", "width": 13}).count() == 3
    with pytest.raises(ValueError):
        files.with_sidecar(spark, path, str(tmp_path / "t.json"), {"sha": "y"})
    paths = spark.createDataFrame([("m/meta_v2.json",), ("m/meta_v10.json",), ("m/other.json",)], "path string")
    assert files.latest_version(paths).first() == ("m/meta_v10.json", 10)


def test_pages(spark):
    rounds = "<tr>" + "<td>Round</td>" * 10 + "</tr>"
    rounds += "<tr><td>A B</td><td>0 1</td><td><p>10 of 20</p><p>5 of 9</p></td><td>50%</td><td>11 of 21</td><td><p>1 of 3</p><p>0 of 2</p></td><td>33%</td><td>0</td><td>0</td><td><p>1:05</p><p>--</p></td></tr>"
    html = [
        "<html><title> Jon &amp; Co </title><script>var t='<tr><td>x</td></tr>'</script><table>" + rounds + "</table></html>",
        '<span class="b-content__title-highlight">Jon Jones</span><ul><li><i>Height:</i> 6\' 4"</li><li><i>Reach:</i> 84"</li><li>STANCE: Orthodox</li><li>DOB: Jul 19, 1987</li></ul>',
        '<table><tr><td><a href="/e/1">Gala 1</a> <span>March 28, 2020</span></td><td>Las Vegas</td></tr><tr><td>no date</td><td>x</td></tr></table>',
        '<td class="but-sg" data-li="[5,1,77]"><span>-150</span></td><td data-li="[6,1,77]"><span>-140</span></td><td data-li="[5,2,77]"><span>+130</span></td><td data-li="[7,2,77]"><span></span></td><div id="hfmr8-captcha"></div>',
    ]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert [r.title for r in pages.page_facts(df).orderBy("page_id").collect()] == ["Jon & Co", None, None, None]
    r = [x for x in pages.bout_rounds(df).collect() if x.sig_red is not None]
    assert [tuple(x)[2:] for x in r] == [(10, 5, 1, 0, 65, None)]
    p = pages.fighter_profile(df.filter("page_id = 1")).first()
    assert (p["name"], p.height, p.reach, p.stance, p.born) == ("Jon Jones", 76.0, 84.0, "Orthodox", D(1987, 7, 19))
    assert [tuple(x) for x in pages.event_list(df.filter("page_id = 2")).collect()] == [("Gala 1", "/e/1", D(2020, 3, 28), "Las Vegas")]
    assert sorted(tuple(x) for x in pages.moneylines(df).collect()) == [("u3", 77, 1, -150, -150, -140, 2), ("u3", 77, 2, 130, 130, 130, 1)]
    assert [x[0] for x in df.orderBy("page_id").select(pages.has_captcha(df.html)).collect()] == [False, False, False, True]


def test_partitions_and_aliases(spark, tmp_path):
    path = str(tmp_path / "elo")
    df = lambda rows: spark.createDataFrame(rows, "fighter long, elo double, elo_type string")
    tables.replace_partitions(df([(1, 1.0, "overall"), (1, 2.0, "striking")]), path, ["elo_type"])
    tables.replace_partitions(df([(2, 3.0, "overall")]), path, ["elo_type"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(2, 3.0, "overall"), (1, 2.0, "striking")}
    tables.drop_partition(spark, path, "elo_type", "striking")
    assert spark.read.parquet(path).count() == 1

    old = spark.createDataFrame([("herb-dean", ["Herb Dean"])], "slug string, alias_list array<string>")
    raw = spark.createDataFrame([("herb-dean", "Herbert Dean"), ("herb-dean", "Herb Dean"), ("marc", "Marc")], "slug string, name string")
    assert {r.slug: r.alias_list for r in tables.append_alias(old, raw, "slug").collect()} == {"herb-dean": ["Herb Dean", "Herbert Dean"], "marc": ["Marc"]}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, D(2020, 1, 2), float("nan")), (2, None, 0.5)], "id long, day date, v double")
    tables.export_csv(tables.finite(rows).coalesce(1), str(tmp_path / "c"))
    text_ = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text_ == "id,day,v\n1,2020-01-02,\n2,,0.5\n"
    for _ in range(2):
        tables.append_log(rows, str(tmp_path / "log"))
    lines = [json.loads(x) for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and sum("v" in x for x in lines) == 2
    tables.ranked_json(rows.fillna(9.0), str(tmp_path / "r"), "v", "id")
    ranked = [json.loads(x) for p in (tmp_path / "r").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["id"]: x["rank"] for x in ranked} == {2: 1, 1: 2} and all("day" in x for x in ranked)
    assert tables.round_trip(rows, str(tmp_path / "p")).count() == 2
    n, same = tables.digest(rows)
    assert (n, same) == tables.digest(rows.orderBy("v")) and tables.digest(rows.union(rows.limit(1)))[1] != same
    assert tables.digest(rows.withColumn("v", rows.v + 1))[1] != same and tables.digest(rows.filter("id = 1"))[0] == 1


def test_round_trip_tells_changed_rows(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    held = tables.digest
    monkeypatch.setattr(tables, "digest", lambda df: held(df if df is rows else df.withColumn("t", df.id.cast("string"))))
    with pytest.raises(ValueError, match="doesn't hold"):
        tables.round_trip(rows, str(tmp_path / "p"))


def test_names(spark):
    rows = spark.createDataFrame([("Ovince Saint-Preux",), ("St. Preux",), ("Beltrán  Mike",), (None,)], "n string")
    got = [tuple(r) for r in rows.select(text.normal_name(rows.n), text.slug(rows.n), text.last_name(rows.n), text.association(rows.n)).collect()]
    assert got == [("ovince st preux", "ovince-saint-preux", "saint-preux", "ovince saint-preux"), ("st preux", "st-preux", "preux", "st. preux"), ("beltrán mike", "beltran-mike", "mike", "beltrán  mike"), (None, None, None, None)]
