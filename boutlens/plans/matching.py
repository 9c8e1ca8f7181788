"""Queries that match rows by pair, day, name and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.functions import text
from boutlens.operators import matching
from boutlens.plans.base import BOUTS, RATED, rated
from boutlens.plans.bouts import bouts, sides, table
from boutlens.plans.registry import query

#: a second source of the same bouts: some are missing, some have their sides swapped, some are a few days off
OTHER = """, other AS (SELECT fight_id + 1000000 AS id, event_date + CAST(CASE WHEN fight_id % 8 = 3 THEN fight_id % 9 ELSE 0 END AS INT) AS day,
  CASE WHEN fight_id % 4 = 1 THEN fighter_b ELSE fighter_a END AS a, CASE WHEN fight_id % 4 = 1 THEN fighter_a ELSE fighter_b END AS b FROM bouts WHERE fight_id % 5 <> 2),
own AS (SELECT fight_id, event_date AS day, fighter_a AS a, fighter_b AS b FROM bouts)
"""


def _own(spark, sf_dir) -> DataFrame:
    return bouts(spark, sf_dir).select("fight_id", F.col("event_date").alias("day"), F.col("fighter_a").alias("a"), F.col("fighter_b").alias("b"))


def _other(spark, sf_dir) -> DataFrame:
    k, swap = F.col("fight_id"), F.col("fight_id") % 4 == 1
    late = F.when(k % 8 == 3, k % 9).otherwise(0).cast("int")
    return _own(spark, sf_dir).filter("fight_id % 5 <> 2").select(
        (k + 1000000).alias("id"), F.date_add("day", late).alias("day"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")
    )


_PAIRED = OTHER + """, paired AS (SELECT o.fight_id, o.day, o.a, o.b, coalesce(min(r.id) FILTER (r.a = o.a), min(r.id)) AS match_id,
  CASE WHEN count(*) FILTER (r.a = o.a) > 0 THEN 'exact' WHEN count(r.id) > 0 THEN 'swapped' END AS match
  FROM own o LEFT JOIN other r ON o.day = r.day AND least(o.a, o.b) = least(r.a, r.b) AND greatest(o.a, o.b) = greatest(r.a, r.b) GROUP BY ALL)
"""


@query(BOUTS + _PAIRED + "SELECT fight_id, match_id, match FROM paired")
def pair_match(spark, sf_dir) -> DataFrame:
    """Each bout's counterpart in the other source: same day, same pair, in either order."""
    return matching.pair_match(_own(spark, sf_dir), _other(spark, sf_dir)).select("fight_id", "match_id", "match")


@query(BOUTS + _PAIRED + """SELECT year(day) AS year, count(*) AS total, count(*) FILTER (match = 'exact') AS exact, count(*) FILTER (match = 'swapped') AS swapped,
count(*) FILTER (match IS NULL) AS none FROM paired GROUP BY ALL""")
def pair_match_exact_swapped(spark, sf_dir) -> DataFrame:
    met = matching.pair_match(_own(spark, sf_dir), _other(spark, sf_dir))
    return met.groupBy(F.year("day").alias("year")).agg(
        F.count("*").alias("total"), F.count_if(F.col("match") == "exact").alias("exact"), F.count_if(F.col("match") == "swapped").alias("swapped"),
        F.count_if(F.col("match").isNull()).alias("none"),
    )


@query(BOUTS + OTHER + """SELECT fight_id FROM own o WHERE NOT EXISTS (SELECT 1 FROM other r WHERE o.day = r.day AND least(o.a, o.b) = least(r.a, r.b) AND greatest(o.a, o.b) = greatest(r.a, r.b))""")
def pair_unmatched(spark, sf_dir) -> DataFrame:
    return matching.pair_unmatched(_own(spark, sf_dir), _other(spark, sf_dir)).select("fight_id")


@query(BOUTS + OTHER + """SELECT fight_id, match_id, days_apart FROM (SELECT o.fight_id, r.id AS match_id, CAST(abs(o.day - r.day) AS INT) AS days_apart,
row_number() OVER (PARTITION BY o.fight_id ORDER BY abs(o.day - r.day), r.day, r.id) AS n FROM own o JOIN other r
ON least(o.a, o.b) = least(r.a, r.b) AND greatest(o.a, o.b) = greatest(r.a, r.b) AND abs(o.day - r.day) <= 5) WHERE n = 1""")
def asof_nearest_tolerance(spark, sf_dir) -> DataFrame:
    """The nearest bout of the same pair in the other source, at most five days away."""
    own, other = (matching.unordered(df, "a", "b") for df in (_own(spark, sf_dir), _other(spark, sf_dir)))
    return matching.asof_nearest(own, other, ["lo", "hi"], "fight_id", "id", "day", 5)


@query("""WITH shifted AS (SELECT event_id, user_id, value, CAST(ts AS DATE) AS day, event_type FROM events),
asked AS (SELECT o_orderkey AS k, o_custkey % 500 AS user_id, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS day FROM orders),
last AS (SELECT a.k, max(struct_pack(day := s.day, event_id := s.event_id)) AS m FROM asked a JOIN shifted s ON a.user_id = s.user_id AND s.day < a.day GROUP BY ALL)
SELECT a.k, a.user_id, a.day, m.day AS last_day, m.event_id AS last_event_id FROM asked a LEFT JOIN last USING (k)""")
def asof_backward_event(spark, sf_dir) -> DataFrame:
    """A user's latest event before an order's day, strictly."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k.alias("k"), (F.col("o_custkey") % 500).alias("user_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("day"))
    state = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id")
    return matching.asof_backward(asked, state, "user_id", "day", ["event_id"])


@query(BOUTS + RATED + """SELECT r.fighter, r.fight_id, r.event_date, r.rating FROM rated r JOIN (SELECT fighter, max(event_date) AS d FROM rated GROUP BY ALL) m ON r.fighter = m.fighter AND r.event_date = m.d""")
def latest_snapshots_with_ties(spark, sf_dir) -> DataFrame:
    """All ratings of each fighter's last day: the aggregate joined back, ties kept."""
    own = rated(spark, sf_dir).select("fighter", "fight_id", "event_date", "rating")
    last = own.groupBy("fighter").agg(F.max("event_date").alias("event_date"))
    return own.join(last, ["fighter", "event_date"]).select("fighter", "fight_id", "event_date", "rating")


@query(BOUTS + RATED + """SELECT fighter, division, fight_id, event_date, rating FROM (SELECT *, row_number() OVER (PARTITION BY fighter, division ORDER BY event_date DESC, fight_id DESC) AS n FROM rated) WHERE n = 1""")
def latest_by_division(spark, sf_dir) -> DataFrame:
    """The latest rating of each fighter in each division: a struct maximum, folded before the shuffle."""
    best = rated(spark, sf_dir).groupBy("fighter", "division").agg(F.max(F.struct("event_date", "fight_id", "rating")).alias("s"))
    return best.select("fighter", "division", "s.fight_id", "s.event_date", "s.rating")


PEOPLE = """WITH people AS (SELECT s_suppkey AS id, s_name AS name, 'ufcstats' AS source FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey + 100000, upper(s_name), 'sherdog' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey + 200000, lower(s_name), CASE WHEN s_suppkey % 4 = 0 THEN 'kaggle-rajeevw' ELSE 'elsewhere' END FROM supplier),
aliases AS (SELECT s_suppkey AS id, 'The ' || s_suppkey % 10 || 'th' AS alias FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'Hammer' FROM supplier WHERE s_suppkey % 20 = 0)
"""


def _people(spark, sf_dir) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    one = s.filter(k % 3 != 0).select(k.alias("id"), F.col("s_name").alias("name"), F.lit("ufcstats").alias("source"))
    two = s.filter(k % 2 == 0).select((k + 100000).alias("id"), F.upper("s_name").alias("name"), F.lit("sherdog").alias("source"))
    three = s.select((k + 200000).alias("id"), F.lower("s_name").alias("name"), F.when(k % 4 == 0, "kaggle-rajeevw").otherwise("elsewhere").alias("source"))
    return one.unionByName(two).unionByName(three)


def _aliases(spark, sf_dir) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    one = s.filter(k % 5 == 0).select(k.alias("id"), F.concat(F.lit("The "), (k % 10).cast("string"), F.lit("th")).alias("alias"))
    return one.unionByName(s.filter(k % 20 == 0).select(k.alias("id"), F.lit("Hammer").alias("alias")))


@query(PEOPLE + """SELECT id, name, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY CASE source WHEN 'ufcstats' THEN 0 WHEN 'sherdog' THEN 1 WHEN 'kaggle-rajeevw' THEN 2 ELSE 99 END, id) AS n FROM people) WHERE n = 1""")
def prefer_canonical_names(spark, sf_dir) -> DataFrame:
    return matching.prefer_canonical(_people(spark, sf_dir), F.lower("name"), "source", "id")


@query(PEOPLE + """SELECT DISTINCT p.id, p.name, p.source FROM people p LEFT JOIN aliases a ON p.id = a.id WHERE p.name ILIKE '%0007%' OR a.alias ILIKE '%0007%' OR a.alias ILIKE '%hammer%' OR p.name ILIKE '%hammer%'""")
def search_by_name_or_alias(spark, sf_dir) -> DataFrame:
    people, aliases = _people(spark, sf_dir), _aliases(spark, sf_dir)
    return matching.search(people, aliases, "0007").unionByName(matching.search(people, aliases, "HAMMER")).distinct()


@query(PEOPLE + """, wanted AS (SELECT s_name AS wanted FROM supplier WHERE s_suppkey % 10 = 1 UNION ALL SELECT 'Supplier#0000000' UNION ALL SELECT 'Nobody'),
person AS (SELECT lower(name) AS n, arg_min(id, CASE source WHEN 'ufcstats' THEN 0 WHEN 'sherdog' THEN 1 WHEN 'kaggle-rajeevw' THEN 2 ELSE 99 END) AS id FROM people GROUP BY ALL),
e AS (SELECT wanted, id, 1 AS candidates FROM wanted JOIN person ON lower(wanted) = n),
l AS (SELECT w.wanted, min(p.id) AS id, count(DISTINCT p.id) AS candidates FROM (SELECT * FROM wanted WHERE wanted NOT IN (SELECT wanted FROM e)) w LEFT JOIN person p ON p.n = lower(w.wanted) GROUP BY ALL)
SELECT * FROM e UNION ALL SELECT wanted, CASE WHEN candidates = 1 THEN id END, CAST(candidates AS INT) FROM l""")
def resolve_names(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 1").select(F.col("s_name").alias("wanted"))
    more = spark.createDataFrame([("Supplier#0000000",), ("Nobody",)], "wanted string")
    return matching.resolve_name(_people(spark, sf_dir), s.unionByName(more))


_DELTA = """, delta AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN 'new ' || s_name END AS name, CASE WHEN s_suppkey % 6 = 0 THEN s_acctbal + 1 END AS balance FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey + 500000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 50 = 0),
old AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS balance FROM supplier)
"""


def _old_and_delta(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    old = s.select(k.alias("k"), F.col("s_name").alias("name"), F.when(k % 5 != 0, F.col("s_acctbal")).alias("balance"))
    one = s.filter(k % 2 == 0).select(k.alias("k"), F.when(k % 4 != 0, F.concat(F.lit("new "), "s_name")).alias("name"), F.when(k % 6 == 0, F.col("s_acctbal") + 1).alias("balance"))
    return old, one.unionByName(s.filter(k % 50 == 0).select((k + 500000).alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("WITH x AS (SELECT 1)" + _DELTA + "SELECT k, coalesce(d.name, o.name) AS name, coalesce(d.balance, o.balance) AS balance FROM old o FULL JOIN delta d USING (k)")
def upsert_merge(spark, sf_dir) -> DataFrame:
    """New values win over old ones, nulls don't."""
    return matching.upsert(*_old_and_delta(spark, sf_dir), ["k"])


@query("WITH x AS (SELECT 1)" + _DELTA + "SELECT k, CASE WHEN d.k IS NOT NULL THEN d.name ELSE o.name END AS name, CASE WHEN d.k IS NOT NULL THEN d.balance ELSE o.balance END AS balance FROM old o FULL JOIN delta d ON o.k = d.k".replace("SELECT k,", "SELECT coalesce(o.k, d.k) AS k,"))
def upsert_with_nulls(spark, sf_dir) -> DataFrame:
    return matching.upsert(*_old_and_delta(spark, sf_dir), ["k"], nulls_overwrite=True)


@query("WITH x AS (SELECT 1)" + _DELTA + "SELECT k, coalesce(o.name, d.name) AS name, coalesce(o.balance, d.balance) AS balance FROM old o FULL JOIN delta d USING (k)")
def source_precedence_fill(spark, sf_dir) -> DataFrame:
    """The preferred source's nulls filled from the other."""
    return matching.fill_nulls(*_old_and_delta(spark, sf_dir), ["k"])


@query("WITH x AS (SELECT 1)" + _DELTA + "SELECT o.k, o.name, coalesce(o.balance, d.balance) AS balance FROM old o LEFT JOIN delta d ON o.k = d.k")
def set_once_assignment(spark, sf_dir) -> DataFrame:
    old, delta = _old_and_delta(spark, sf_dir)
    return matching.set_once(old, delta, "k", "balance")


@query(BOUTS + """SELECT d AS day, count(*) AS bouts, count(DISTINCT division) AS divisions FROM (SELECT event_date AS d, division FROM bouts) WHERE d IN (SELECT event_date FROM bouts GROUP BY event_date HAVING count(DISTINCT division) > 1) GROUP BY ALL""")
def crowded_days(spark, sf_dir) -> DataFrame:
    """Days with bouts in several divisions."""
    days = bouts(spark, sf_dir).groupBy(F.col("event_date").alias("day")).agg(F.count("*").alias("bouts"), F.countDistinct("division").alias("divisions"))
    return days.filter("divisions > 1")


@query(BOUTS + """, keyed AS (SELECT CAST(event_date AS VARCHAR) || '|' || fighter_a || '|' || fighter_b AS key, fight_id FROM bouts)
SELECT day, count(*) AS pairs, count(*) FILTER (n > 1) AS violations, sum(n) AS bouts FROM (SELECT CAST(split_part(key, '|', 1) AS DATE) AS day, key, count(DISTINCT fight_id) AS n FROM keyed GROUP BY ALL) GROUP BY ALL""".replace("sum(n) AS bouts", "CAST(sum(n) AS BIGINT) AS bouts"))
def pair_integrity(spark, sf_dir) -> DataFrame:
    """Pairs with several bouts on one day, counted by day through the pair's text key."""
    keyed = bouts(spark, sf_dir).select(text.pair_key(F.col("event_date"), F.col("fighter_b"), F.col("fighter_a")).alias("key"), "fight_id")
    per = keyed.groupBy("key").agg(F.countDistinct("fight_id").alias("n"))
    return per.groupBy(text.pair_key_parts(F.col("key"))[0].alias("day")).agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("violations"), F.sum("n").alias("bouts"))


@query("""SELECT vec_id AS query, other, round(c, 6) AS cosine, CAST(n AS INT) AS place FROM (
SELECT q.vec_id, e.vec_id AS other, list_cosine_similarity(q.v, e.v) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS n
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 5) q JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e ON q.vec_id <> e.vec_id) WHERE n <= 10""")
def similar_topk(spark, sf_dir) -> DataFrame:
    """The ten vectors nearest to each of five asked ones; the asked vectors are few and broadcast."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = e.filter("vec_id < 5").select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))
    met = e.join(F.broadcast(asked), F.col("vec_id") != F.col("query")).select("query", F.col("vec_id").alias("other"), cosine.alias("c"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("c", 9)), "other"))
    return met.withColumn("place", place).filter("place <= 10").select("query", "other", F.round("c", 6).alias("cosine"), "place")


@query(BOUTS + """SELECT fighter, fight_id AS latest_fight, division AS latest_division FROM (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY event_date DESC, fight_id DESC) AS n FROM sides) WHERE n = 1""")
def latest_bout(spark, sf_dir) -> DataFrame:
    best = sides(spark, sf_dir).groupBy("fighter").agg(F.max(F.struct("event_date", "fight_id", "division")).alias("s"))
    return best.select("fighter", F.col("s.fight_id").alias("latest_fight"), F.col("s.division").alias("latest_division"))
