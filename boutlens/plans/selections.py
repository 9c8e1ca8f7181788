"""Queries that select, split and compare sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlens.functions import text
from boutlens.operators import graph, matching
from boutlens.plans.base import BOUTS, PHYSICALS, RATED, ROUNDS, VENUES, physicals, placed_bouts, rated, rounds, venues
from boutlens.plans.bouts import bouts, sides, table
from boutlens.plans.registry import query


@query(BOUTS + "SELECT DISTINCT fighter, division FROM sides")
def fighter_divisions(spark, sf_dir) -> DataFrame:
    return sides(spark, sf_dir).select("fighter", "division").distinct()


@query(BOUTS + """, d AS (SELECT fighter, list_sort(list(DISTINCT division)) AS ds FROM sides GROUP BY ALL)
SELECT a.fighter AS fighter_a, b.fighter AS fighter_b, coalesce(list_sort(list_intersect(a.ds, b.ds))[1], a.ds[1]) AS division, len(list_intersect(a.ds, b.ds)) > 0 AS common
FROM d a JOIN d b ON b.fighter = a.fighter + 1""")
def common_division(spark, sf_dir) -> DataFrame:
    """The first division, by name, that two fighters share; without one the first of the first fighter's."""
    d = sides(spark, sf_dir).groupBy("fighter").agg(F.array_sort(F.collect_set("division")).alias("ds"))
    other = d.select((F.col("fighter") - 1).alias("fighter"), F.col("fighter").alias("fighter_b"), F.col("ds").alias("other"))
    both = F.array_intersect("ds", "other")
    return d.join(other, "fighter").select(F.col("fighter").alias("fighter_a"), "fighter_b", F.coalesce(F.array_min(both), F.get("ds", F.lit(0))).alias("division"), (F.size(both) > 0).alias("common"))


@query("""WITH k AS (SELECT event_id, list_sort(list_filter(['k', event_type, CASE WHEN event_id % 3 = 0 THEN 'extra' END], lambda x: x IS NOT NULL)) AS keys FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(keys, lambda x: x NOT IN ('k', 'click', 'view'))), ',') AS unknown FROM k""")
def unknown_keys(spark, sf_dir) -> DataFrame:
    """Populated keys that aren't allowed."""
    keys = F.array_compact(F.array(F.lit("k"), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "extra")))
    left = F.array_sort(F.array_except(keys, F.array(F.lit("k"), F.lit("click"), F.lit("view"))))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(left, ",").alias("unknown"))


_NAMES = """WITH held AS (SELECT s_suppkey AS id, 'main' AS database, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0),
fresh AS (SELECT s_suppkey AS id, 'main' AS database, CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier WHERE s_suppkey % 2 = 0)
"""


def _held_and_fresh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    held = s.filter(k % 3 != 0).select(k.alias("id"), F.lit("main").alias("database"), F.col("s_name").alias("name"))
    fresh = s.filter(k % 2 == 0).select(k.alias("id"), F.lit("main").alias("database"), F.when(k % 5 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name"))
    return held, fresh


@query(_NAMES + """SELECT f.id, f.name, CASE WHEN h.id IS NULL THEN 'additive' WHEN h.name <> f.name THEN 'conflict' ELSE 'same' END AS kind FROM fresh f LEFT JOIN held h USING (database, id)""")
def name_refresh_split(spark, sf_dir) -> DataFrame:
    """New names that are only added, those that contradict and those that agree."""
    held, fresh = _held_and_fresh(spark, sf_dir)
    met = fresh.join(held.withColumnRenamed("name", "old"), ["database", "id"], "left")
    return met.select("id", "name", F.when(F.col("old").isNull(), "additive").when(F.col("old") != F.col("name"), "conflict").otherwise("same").alias("kind"))


@query(_NAMES + "SELECT id, database, name FROM fresh UNION ALL SELECT id, database, name FROM held h WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.id = h.id AND f.database = h.database)")
def overlay_union(spark, sf_dir) -> DataFrame:
    """Both sets of rows; new ones win."""
    held, fresh = _held_and_fresh(spark, sf_dir)
    return fresh.unionByName(held.join(fresh.select("id", "database"), ["id", "database"], "left_anti").select("id", "database", "name"))


@query("""WITH seen AS (SELECT 'http://e/' || o_orderkey AS url, 'E' || o_orderkey % 700 AS name, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 3 = 0),
coming AS (SELECT o_orderkey AS k, 'http://e/' || (o_orderkey + o_orderkey % 2) AS url, 'E' || o_orderkey % 700 AS name, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT k FROM coming c WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.url = c.url) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.name = c.name AND s.day = c.day) AND day > DATE '1997-01-01'""")
def incremental_new(spark, sf_dir) -> DataFrame:
    """Incoming events after a date that neither their link nor their name and day have been seen with."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("E"), (k % 700).cast("string")).alias("name"), F.to_date("o_orderdate").alias("day"))
    link = lambda n: F.concat(F.lit("http://e/"), n.cast("string")).alias("url")
    seen = rows.filter("k % 3 = 0").select(link(F.col("k")), "name", "day")
    coming = rows.select("k", link(F.col("k") + F.col("k") % 2), "name", "day").filter(F.col("day") > F.lit("1997-01-01").cast("date"))
    return coming.join(seen.select("url"), "url", "left_anti").join(seen.select("name", "day"), ["name", "day"], "left_anti").select("k")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 8 AS rounds, l_suppkey % 50 AS a, l_partkey % 50 AS b, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT 'rounds' AS rule, count(*) FILTER (rounds NOT BETWEEN 1 AND 5) AS violations FROM r UNION ALL SELECT 'same_fighter', count(*) FILTER (a = b) FROM r UNION ALL SELECT 'round_number', count(*) FILTER (l_linenumber NOT BETWEEN 0 AND 5) FROM r
UNION ALL SELECT 'future', count(*) FILTER (day > DATE '2001-06-01') FROM r""")
def constraint_violations(spark, sf_dir) -> DataFrame:
    """How many rows break each constraint, in one pass."""
    r = table(spark, sf_dir, "lineitem").agg(
        F.count_if(~(F.col("l_partkey") % 8).between(1, 5)).alias("rounds"), F.count_if(F.col("l_suppkey") % 50 == F.col("l_partkey") % 50).alias("same_fighter"),
        F.count_if(~F.col("l_linenumber").between(0, 5)).alias("round_number"), F.count_if(F.to_date("l_shipdate") > F.lit("2001-06-01").cast("date")).alias("future"),
    )
    return r.unpivot([], ["rounds", "same_fighter", "round_number", "future"], "rule", "violations")


@query(BOUTS + """, f AS (SELECT fight_id, fighter, CASE fight_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_date - 3 WHEN 2 THEN event_date ELSE event_date + 2 END AS as_of, '{"td_rate": ' || fight_id % 7 || ', "style_tag": "s' || fighter % 3 || '"}' AS features FROM sides)
SELECT f.fight_id, f.fighter, CAST(json_extract_string(features, '$.td_rate') AS DOUBLE) AS td_rate, json_extract_string(features, '$.style_tag') AS style_tag FROM f JOIN bouts b ON f.fight_id = b.fight_id WHERE as_of IS NULL OR as_of <= b.event_date""")
def features_valid_at(spark, sf_dir) -> DataFrame:
    """Stored features that were known at the bout's day, projected out of their JSON."""
    k = F.col("fight_id")
    as_of = F.when(k % 4 == 0, None).when(k % 4 == 1, F.date_sub("event_date", 3)).when(k % 4 == 2, F.col("event_date")).otherwise(F.date_add("event_date", 2))
    js = F.to_json(F.struct((k % 7).alias("td_rate"), F.concat(F.lit("s"), (F.col("fighter") % 3).cast("string")).alias("style_tag")))
    f = sides(spark, sf_dir).select("fight_id", "fighter", as_of.alias("as_of"), js.alias("features"))
    met = f.join(bouts(spark, sf_dir).select("fight_id", "event_date"), "fight_id").filter("as_of is null or as_of <= event_date")
    parsed = F.from_json("features", "td_rate double, style_tag string")
    return met.select("fight_id", "fighter", parsed["td_rate"].alias("td_rate"), parsed["style_tag"].alias("style_tag"))


@query(BOUTS + """, m AS (SELECT *, CASE WHEN fight_id % 7 = 0 THEN 'Other' WHEN fight_id % 30 = 0 THEN NULL ELSE method END AS how FROM bouts)
SELECT fight_id, how FROM m WHERE NOT (winner IS NULL AND (how IS NULL OR how IN ('Other', 'No Contest')))""")
def counted_bouts(spark, sf_dir) -> DataFrame:
    """Bouts that a rating counts: not those without a winner that ended in no known way."""
    k = F.col("fight_id")
    m = bouts(spark, sf_dir).withColumn("how", F.when(k % 7 == 0, "Other").when(k % 30 == 0, None).otherwise(F.col("method")))
    void = F.col("winner").isNull() & (F.col("how").isNull() | F.col("how").isin("Other", "No Contest"))
    return m.filter(~void).select("fight_id", "how")


@query("""SELECT asked, division FROM (VALUES ('heavy', 'Light Heavyweight'), ('WELTER', 'Welterweight'), ('women''s f', 'Women''s Featherweight'), ('catch', NULL), ('', NULL), ('straw', 'Women''s Strawweight'), ('weight', 'Women''s Featherweight')) t(asked, division)""")
def resolve_division(spark, sf_dir) -> DataFrame:
    """The rankable division that a part of its name means, the longest first."""
    asked = spark.createDataFrame([("heavy",), ("WELTER",), ("women's f",), ("catch",), ("",), ("straw",), ("weight",)], "asked string")
    return asked.select("asked", text.matching_division(F.col("asked")).alias("division"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (user_id % 3 <> 0) AS with_source FROM events WHERE event_type LIKE 'c%' OR event_type LIKE 'v%' GROUP BY ALL""")
def prefix_and_source(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").startswith("c") | F.col("event_type").startswith("v"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 3 != 0).alias("with_source"))


@query(BOUTS + "SELECT a.fight_id AS one, b.fight_id AS two FROM bouts a JOIN bouts b ON a.event_date = b.event_date AND a.division < b.division WHERE a.fight_id % 3 = 0")
def same_date_events(spark, sf_dir) -> DataFrame:
    """Bouts of one day in two divisions: the pairs are as many as the square of a day's bouts, the bouts are derived once."""
    b = graph.stored(bouts(spark, sf_dir).select("fight_id", "event_date", "division"))
    one = b.filter("fight_id % 3 = 0").select(F.col("fight_id").alias("one"), "event_date", F.col("division").alias("d1"))
    return one.join(b.select(F.col("fight_id").alias("two"), "event_date", F.col("division").alias("d2")), "event_date").filter("d1 < d2").select("one", "two")


@query(BOUTS + ", oof AS (SELECT fight_id, CASE WHEN fight_id % 6 <> 0 THEN (fight_id % 100) / 100.0::DOUBLE END AS prob FROM bouts WHERE fight_id % 4 <> 0) SELECT b.fight_id, prob FROM bouts b JOIN oof o ON b.fight_id = o.fight_id WHERE prob IS NOT NULL AND b.fight_id IN (SELECT fight_id FROM bouts WHERE event_date >= DATE '1998-01-01')")
def oof_restricted(spark, sf_dir) -> DataFrame:
    """Held-out probabilities met by bout; misses and bouts outside the paired set go."""
    b = bouts(spark, sf_dir).select("fight_id", "event_date")
    k = F.col("fight_id")
    oof = b.filter(k % 4 != 0).select("fight_id", F.when(k % 6 != 0, k % 100 / 100.0).alias("prob")).dropna()
    paired = b.filter(F.col("event_date") >= F.lit("1998-01-01").cast("date")).select("fight_id")
    return b.select("fight_id").join(oof, "fight_id").join(paired, "fight_id", "left_semi")


@query(BOUTS + ROUNDS + """SELECT fight_id, fighter, list(struct_pack(round := round, landed := landed, td_landed := td_landed) ORDER BY round).map(lambda x: x.round || ':' || x.landed || ':' || x.td_landed).array_to_string(' ') AS rounds FROM rounds WHERE round > 0 GROUP BY ALL""".replace("list(struct_pack(round := round, landed := landed, td_landed := td_landed) ORDER BY round).map(lambda x: x.round || ':' || x.landed || ':' || x.td_landed).array_to_string(' ')", "string_agg(round || ':' || landed || ':' || td_landed, ' ' ORDER BY round)"))
def rounds_by_side(spark, sf_dir) -> DataFrame:
    """Each side's rounds in order."""
    by = rounds(spark, sf_dir).filter("round > 0").groupBy("fight_id", "fighter").agg(F.array_sort(F.collect_list(F.struct("round", "landed", "td_landed"))).alias("l"))
    return by.select("fight_id", "fighter", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["round"], x["landed"], x["td_landed"])), " ").alias("rounds"))


_TYPES = RATED + """, snaps AS (SELECT fighter, fight_id, 'overall' AS kind, rating FROM rated WHERE fight_id % 3 <> 0 UNION ALL SELECT fighter, fight_id, 'striking', rating + 10 FROM rated WHERE fight_id % 4 <> 0 UNION ALL SELECT fighter, fight_id, 'grappling', rating - 10 FROM rated WHERE fight_id % 5 <> 0)
"""


@query(BOUTS + _TYPES + "SELECT fighter, fight_id, coalesce(max(rating) FILTER (kind = 'overall'), 1500) AS elo_overall, coalesce(max(rating) FILTER (kind = 'striking'), 1500) AS elo_striking, coalesce(max(rating) FILTER (kind = 'grappling'), 1500) AS elo_grappling FROM snaps GROUP BY ALL")
def rating_pivot(spark, sf_dir) -> DataFrame:
    """The three ratings of a side in one row, 1500 where one is missing."""
    r, k = rated(spark, sf_dir), F.col("fight_id")
    part = lambda kind, shift, m: r.filter(k % m != 0).select("fighter", "fight_id", F.lit(kind).alias("kind"), (F.col("rating") + shift).alias("rating"))
    snaps = part("overall", 0, 3).unionByName(part("striking", 10, 4)).unionByName(part("grappling", -10, 5))
    wide = snaps.groupBy("fighter", "fight_id").pivot("kind", ["overall", "striking", "grappling"]).agg(F.max("rating")).fillna(1500.0)
    return wide.withColumnsRenamed({c: f"elo_{c}" for c in ("overall", "striking", "grappling")})


@query(BOUTS + "SELECT fight_id, event_date, fighter_a, fighter_b, division, method, 3 AS num_rounds, CASE WHEN fight_id % 13 <> 0 THEN CAST(1 + fight_id % 3 AS INT) END AS round_finished, CASE WHEN fight_id % 13 <> 0 THEN (fight_id % 5) || ':' || lpad(CAST((fight_id * 7) % 60 AS VARCHAR), 2, '0') END AS time_finished FROM bouts WHERE winner IS NOT NULL")
def decided_bouts_with_duration(spark, sf_dir) -> DataFrame:
    k = F.col("fight_id")
    known = k % 13 != 0
    clock = F.concat((k % 5).cast("string"), F.lit(":"), F.lpad(((k * 7) % 60).cast("string"), 2, "0"))
    return bouts(spark, sf_dir).filter("winner is not null").select("fight_id", "event_date", "fighter_a", "fighter_b", "division", "method", F.lit(3).alias("num_rounds"), F.when(known, (1 + k % 3).cast("int")).alias("round_finished"), F.when(known, clock).alias("time_finished"))


@query(BOUTS + VENUES + "SELECT p.fight_id, CASE WHEN v.lat IS NOT NULL AND v.lon IS NOT NULL AND v.zone IS NOT NULL THEN v.venue_id END AS usable_venue, v.country FROM placed_bouts p LEFT JOIN venues v ON p.venue_id = v.venue_id")
def event_venues(spark, sf_dir) -> DataFrame:
    """A bout's venue, usable only where its place and zone are all known."""
    met = placed_bouts(spark, sf_dir).join(venues(spark, sf_dir), "venue_id", "left")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("zone").isNotNull()
    return met.select("fight_id", F.when(known, F.col("venue_id")).alias("usable_venue"), "country")


@query(BOUTS + PHYSICALS + "SELECT division, count(*) AS bouts, count(DISTINCT fighter) AS fighters, count(*) FILTER (born IS NULL) AS unknown_age FROM sides JOIN physicals USING (fighter) WHERE division IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def listed_divisions(spark, sf_dir) -> DataFrame:
    met = sides(spark, sf_dir).filter(F.col("division").isin("BUILDING", "MACHINERY")).join(physicals(spark, sf_dir), "fighter")
    return met.groupBy("division").agg(F.count("*").alias("bouts"), F.countDistinct("fighter").alias("fighters"), F.count_if(F.col("born").isNull()).alias("unknown_age"))


@query(BOUTS + """, raw AS (SELECT fight_id % 400 AS event, CASE fight_id % 5 WHEN 0 THEN 'Herb Dean' WHEN 1 THEN 'herb dean ' ELSE 'Marc Goddard' END AS name FROM bouts), slugs AS (SELECT event, regexp_replace(trim(lower(name)), '\\s+', '-', 'g') AS referee FROM raw),
n AS (SELECT event, referee, count(*) AS n FROM slugs GROUP BY ALL) SELECT event, CASE WHEN event % 9 = 0 THEN 'kept' ELSE arg_max(referee, (n, referee)) END AS referee FROM n GROUP BY event""")
def event_referee_mode(spark, sf_dir) -> DataFrame:
    """The referee most often named for an event, set only where none was."""
    k = F.col("fight_id")
    raw = bouts(spark, sf_dir).select((k % 400).alias("event"), text.slug(F.when(k % 5 == 0, "Herb Dean").when(k % 5 == 1, "herb dean ").otherwise("Marc Goddard"), {"herbert-dean": "herb-dean"}).alias("referee"))
    best = raw.groupBy("event", "referee").agg(F.count("*").alias("n")).groupBy("event").agg(F.max(F.struct("n", "referee")).alias("m")).select("event", F.col("m.referee").alias("referee"))
    old = best.select("event", F.when(F.col("event") % 9 == 0, "kept").alias("referee"))
    return matching.set_once(old, best, "event", "referee")


@query(BOUTS + """, c AS (SELECT event_date, fighter, split_part(s_name, '#', 2) AS nm, s_name FROM sides JOIN supplier ON fighter = s_suppkey) SELECT event_date, right(nm, 2) AS last_name, count(DISTINCT fighter) AS fighters, count(DISTINCT fighter) > 1 AS ambiguous FROM c GROUP BY ALL""")
def same_card_names(spark, sf_dir) -> DataFrame:
    """How many fighters of a day share the end of their name: more than one can't be told apart by it."""
    met = sides(spark, sf_dir).select("event_date", "fighter").join(physicals(spark, sf_dir).select("fighter", F.right(F.element_at(F.split("name", "#"), 2), F.lit(2)).alias("last_name")), "fighter")
    return met.groupBy("event_date", "last_name").agg(F.countDistinct("fighter").alias("fighters")).withColumn("ambiguous", F.col("fighters") > 1)


@query(BOUTS + RATED + """, b AS (SELECT fighter, division, event_date, fight_id, rating, count(*) OVER (PARTITION BY fighter) AS n, row_number() OVER (PARTITION BY fighter, division ORDER BY event_date DESC, fight_id DESC) AS k FROM rated),
x AS (SELECT * FROM b WHERE k = 1 AND division = 'BUILDING'), d AS (SELECT *, row_number() OVER (PARTITION BY fighter % 60 ORDER BY CASE fighter % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 99 END, rating DESC, fighter) AS dup FROM x)
SELECT CAST(row_number() OVER (ORDER BY rating DESC, fighter) AS INT) AS place, fighter, rating, n AS bouts FROM d WHERE dup = 1 ORDER BY rating DESC, fighter LIMIT 15""")
def rating_rankings(spark, sf_dir) -> DataFrame:
    """A division's ranking by latest rating; of entries of one person (here: id modulo 60) the most trusted source counts."""
    r = rated(spark, sf_dir)
    latest = r.groupBy("fighter", "division").agg(F.max(F.struct("event_date", "fight_id", "rating")).alias("s")).filter("division = 'BUILDING'").select("fighter", "s.rating")
    n = r.groupBy("fighter").agg(F.count("*").alias("bouts"))
    source = F.when(F.col("fighter") % 3 == 0, 0).when(F.col("fighter") % 3 == 1, 1).otherwise(99)
    best = latest.groupBy((F.col("fighter") % 60).alias("person")).agg(F.min(F.struct(source.alias("s"), (-F.col("rating")).alias("r"), "fighter")).alias("b"))
    top = best.select("b.fighter", (-F.col("b.r")).alias("rating")).join(n, "fighter").orderBy(F.desc("rating"), "fighter").limit(15)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rating"), "fighter"))).select("place", "fighter", "rating", "bouts")


@query(BOUTS + RATED + "SELECT fighter, fight_id, event_date, division, rating FROM rated WHERE fighter = 7")
def rating_history(spark, sf_dir) -> DataFrame:
    """One fighter's ratings in the order of time."""
    return rated(spark, sf_dir).filter("fighter = 7").select("fighter", "fight_id", "event_date", "division", "rating").orderBy("event_date", "fight_id")
