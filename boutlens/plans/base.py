"""The domain's relations derived from the base tables, each beside the SQL that derives the same rows.

The base tables hold orders and lines, no contests: bouts, round statistics, prices, measurements, venues and
names are made from their keys by integer arithmetic, so that two engines derive the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.plans.bouts import bouts, sides, table

BOUTS = """
WITH sums AS (SELECT l_orderkey, l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cents DESC, l_suppkey) AS place FROM sums),
pairs AS (SELECT l_orderkey, max(l_suppkey) FILTER (place = 1) AS f, max(l_suppkey) FILTER (place = 2) AS s FROM placed WHERE place <= 2 GROUP BY ALL HAVING count(*) = 2),
bouts AS (
  SELECT o_orderkey AS fight_id, CAST(o_orderdate AS DATE) AS event_date, c_mktsegment AS division, least(f, s) AS fighter_a, greatest(f, s) AS fighter_b,
         CASE WHEN o_orderkey % 10 <> 0 THEN f END AS winner,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'KO/TKO' WHEN '2' THEN 'Submission' WHEN '5' THEN 'DQ' ELSE 'Decision' END AS method
  FROM pairs JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
sides AS (
  SELECT fight_id, event_date, division, method, fighter_a AS fighter, fighter_b AS opponent, CAST(winner = fighter_a AS INT) AS won FROM bouts
  UNION ALL
  SELECT fight_id, event_date, division, method, fighter_b, fighter_a, CAST(winner = fighter_b AS INT) FROM bouts)
"""
BEFORE = "(PARTITION BY fighter ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

#: statistics of each fighter, bout and round
ROUNDS = """, rounds AS (
  SELECT l_orderkey AS fight_id, l_suppkey AS fighter, CAST(l_linenumber AS BIGINT) AS round, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS landed,
         CAST(sum(CAST(l_quantity AS BIGINT)) + 10 * count(*) AS BIGINT) AS attempted, count(*) FILTER (l_returnflag = 'R') AS td_landed,
         count(*) AS td_attempted, CAST(sum(day(l_shipdate)) AS BIGINT) AS control
  FROM lineitem JOIN sides ON l_orderkey = fight_id AND l_suppkey = fighter GROUP BY ALL)
"""
#: sums over the rounds, with the bout's length
STATS = ROUNDS + """, stats AS (
  SELECT s.fight_id, s.event_date, s.division, s.method, s.fighter, s.opponent, s.won, CAST(sum(landed) AS BIGINT) AS landed, CAST(sum(attempted) AS BIGINT) AS attempted,
         CAST(sum(td_landed) AS BIGINT) AS td_landed, CAST(sum(td_attempted) AS BIGINT) AS td_attempted, CAST(sum(control) AS BIGINT) AS control,
         CASE WHEN s.fight_id % 13 = 0 THEN 900 ELSE (s.fight_id % 3) * 300 + (s.fight_id % 5) * 60 + (s.fight_id * 7) % 60 END AS seconds
  FROM sides s JOIN rounds r ON s.fight_id = r.fight_id AND s.fighter = r.fighter GROUP BY ALL)
"""
PHYSICALS = """, physicals AS (
  SELECT s_suppkey AS fighter, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(60 + s_suppkey % 20 AS DOUBLE) END AS height,
         CASE WHEN s_suppkey % 11 <> 0 THEN CAST(58 + (s_suppkey * 3) % 25 AS DOUBLE) END AS reach,
         CASE s_suppkey % 4 WHEN 0 THEN 'Orthodox' WHEN 1 THEN 'Southpaw' WHEN 2 THEN 'Switch' END AS stance,
         CASE WHEN s_suppkey % 13 <> 0 THEN DATE '1960-01-01' + CAST((s_suppkey * 97) % 9000 AS INT) END AS born
  FROM supplier)
"""
RATED = """, rated AS (SELECT *, CAST(1300 + (fight_id * 31 + fighter * 17) % 400 AS DOUBLE) AS rating FROM sides)
"""
ODDS = """, priced AS (SELECT fight_id, event_date, fighter_a, fighter_b, winner, fight_id * 37 + fighter_a AS ka, fight_id * 37 + fighter_b AS kb FROM bouts),
odds AS (
  SELECT fight_id, fighter_a AS fighter, CASE WHEN ka % 2 = 0 THEN -(90 + ka % 300) ELSE 90 + ka % 300 END AS opening,
         CASE WHEN ka % 2 = 0 THEN -(110 + ka % 250) ELSE 110 + ka % 250 END AS close_min, CASE WHEN ka % 2 = 0 THEN -(105 + ka % 260) ELSE 115 + ka % 260 END AS close_max FROM priced WHERE fight_id % 9 <> 0
  UNION ALL
  SELECT fight_id, fighter_b, CASE WHEN kb % 2 = 0 THEN -(90 + kb % 300) ELSE 90 + kb % 300 END,
         CASE WHEN kb % 2 = 0 THEN -(110 + kb % 250) ELSE 110 + kb % 250 END, CASE WHEN kb % 2 = 0 THEN -(105 + kb % 260) ELSE 115 + kb % 260 END FROM priced WHERE fight_id % 9 <> 0)
"""
VENUES = """, venues AS (
  SELECT CAST(n_nationkey AS BIGINT) AS venue_id, CAST(n_nationkey * 6 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS lon,
         CASE n_nationkey % 5 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'America/Phoenix' WHEN 3 THEN 'Asia/Kolkata' ELSE 'Australia/Brisbane' END AS zone,
         CASE n_nationkey % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'Brazil' WHEN 2 THEN 'Australia' WHEN 3 THEN 'Japan' WHEN 4 THEN 'France' END AS country
  FROM nation),
placed_bouts AS (SELECT b.*, CASE WHEN fight_id % 11 <> 0 THEN fight_id % 25 END AS venue_id FROM bouts b)
"""


def rounds(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fight_id"), F.col("l_suppkey").alias("fighter"), F.col("l_linenumber").cast("long").alias("round"),
        F.col("l_quantity").cast("long").alias("q"), "l_returnflag", F.dayofmonth("l_shipdate").cast("long").alias("d"),
    )
    own = lines.join(sides(spark, sf_dir).select("fight_id", "fighter"), ["fight_id", "fighter"], "left_semi")
    return own.groupBy("fight_id", "fighter", "round").agg(
        F.sum("q").alias("landed"), (F.sum("q") + 10 * F.count("*")).alias("attempted"), F.count_if(F.col("l_returnflag") == "R").alias("td_landed"),
        F.count("*").alias("td_attempted"), F.sum("d").alias("control"),
    )


def seconds(fight_id: Column) -> Column:
    """A bout's length: whole three rounds where no time is known."""
    return F.when(fight_id % 13 == 0, F.lit(900)).otherwise((fight_id % 3) * 300 + (fight_id % 5) * 60 + (fight_id * 7) % 60)


def stats(spark, sf_dir: str) -> DataFrame:
    sums = rounds(spark, sf_dir).groupBy("fight_id", "fighter").agg(*(F.sum(c).alias(c) for c in ("landed", "attempted", "td_landed", "td_attempted", "control")))
    return sides(spark, sf_dir).join(sums, ["fight_id", "fighter"]).withColumn("seconds", seconds(F.col("fight_id")))


def physicals(spark, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    stance = F.when(k % 4 == 0, "Orthodox").when(k % 4 == 1, "Southpaw").when(k % 4 == 2, "Switch")
    return table(spark, sf_dir, "supplier").select(
        k.alias("fighter"), F.col("s_name").alias("name"), F.when(k % 7 != 0, (60 + k % 20).cast("double")).alias("height"),
        F.when(k % 11 != 0, (58 + (k * 3) % 25).cast("double")).alias("reach"), stance.alias("stance"),
        F.when(k % 13 != 0, F.date_add(F.lit("1960-01-01").cast("date"), ((k * 97) % 9000).cast("int"))).alias("born"),
    )


def rated(spark, sf_dir: str) -> DataFrame:
    """Sides with a rating made up from the ids."""
    return sides(spark, sf_dir).withColumn("rating", (1300 + (F.col("fight_id") * 31 + F.col("fighter") * 17) % 400).cast("double"))


def odds(spark, sf_dir: str) -> DataFrame:
    """American prices made up from the ids, a row for each side; some opening prices lie where none exists."""
    k = F.col("fight_id") * 37 + F.col("fighter")
    price = lambda below, above, spread: F.when(k % 2 == 0, -(below + k % spread)).otherwise(above + k % spread)
    return sides(spark, sf_dir).filter("fight_id % 9 <> 0").select(
        "fight_id", "fighter", price(90, 90, 300).alias("opening"), price(110, 110, 250).alias("close_min"), price(105, 115, 260).alias("close_max")
    )


def venues(spark, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    zone = F.when(k % 5 == 0, "UTC").when(k % 5 == 1, "Asia/Tokyo").when(k % 5 == 2, "America/Phoenix").when(k % 5 == 3, "Asia/Kolkata").otherwise("Australia/Brisbane")
    country = F.when(k % 6 == 0, "United States").when(k % 6 == 1, "Brazil").when(k % 6 == 2, "Australia").when(k % 6 == 3, "Japan").when(k % 6 == 4, "France")
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("venue_id"), (k * 6 - 60).cast("double").alias("lat"), (k * 13 - 150).cast("double").alias("lon"), zone.alias("zone"), country.alias("country")
    )


def placed_bouts(spark, sf_dir: str) -> DataFrame:
    return bouts(spark, sf_dir).withColumn("venue_id", F.when(F.col("fight_id") % 11 != 0, F.col("fight_id") % 25))
