"""The registered queries over bouts and the base tables, each beside its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlens.functions.odds import devig, implied_probability
from boutlens.operators import career, evaluation, history
from boutlens.plans.base import BEFORE, BOUTS
from boutlens.plans.bouts import bouts, sides, table
from boutlens.plans.registry import query

@query(BOUTS + """SELECT division, fighter, count(*) AS bouts, CAST(coalesce(sum(won), 0) AS BIGINT) AS wins FROM sides
GROUP BY division, fighter ORDER BY wins DESC, bouts, division, fighter LIMIT 50""")
def division_rankings(spark, sf_dir) -> DataFrame:
    """The 50 records of most wins in a division."""
    by = sides(spark, sf_dir).groupBy("division", "fighter").agg(F.count("*").alias("bouts"), F.coalesce(F.sum("won"), F.lit(0)).cast("long").alias("wins"))
    return by.orderBy(F.desc("wins"), "bouts", "division", "fighter").limit(50)


@query(BOUTS + """, records AS (SELECT division, fighter, count(*) AS bouts, CAST(coalesce(sum(won), 0) AS BIGINT) AS wins FROM sides GROUP BY division, fighter),
ranked AS (SELECT *, row_number() OVER (PARTITION BY division ORDER BY wins DESC, bouts, fighter) AS place FROM records)
SELECT division, CAST(place AS INT) AS place, fighter, bouts, wins FROM ranked WHERE place <= 15""")
def division_top15(spark, sf_dir) -> DataFrame:
    """The 15 records of most wins of each division."""
    by = sides(spark, sf_dir).groupBy("division", "fighter").agg(F.count("*").alias("bouts"), F.coalesce(F.sum("won"), F.lit(0)).cast("long").alias("wins"))
    place = F.row_number().over(Window.partitionBy("division").orderBy(F.desc("wins"), "bouts", "fighter"))
    return by.withColumn("place", place).filter("place <= 15").select("division", "place", "fighter", "bouts", "wins")


@query(BOUTS + """SELECT fighter, count(*) AS bouts, count(*) FILTER (won = 1) AS wins, count(*) FILTER (won = 0) AS losses,
count(*) FILTER (won IS NULL) AS draws FROM sides GROUP BY fighter""")
def fighter_record(spark, sf_dir) -> DataFrame:
    return sides(spark, sf_dir).groupBy("fighter").agg(
        F.count("*").alias("bouts"), F.count_if(F.col("won") == 1).alias("wins"), F.count_if(F.col("won") == 0).alias("losses"), F.count_if(F.col("won").isNull()).alias("draws")
    )


@query(BOUTS + f"""SELECT fight_id, fighter, count(*) OVER w AS bouts_before, CAST(coalesce(sum(won) OVER w, 0) AS BIGINT) AS wins_before
FROM sides WINDOW w AS {BEFORE}""")
def cumulative_before(spark, sf_dir) -> DataFrame:
    w = history.before("fighter")
    return sides(spark, sf_dir).select("fight_id", "fighter", F.count("*").over(w).alias("bouts_before"), history.total_before(F.col("won"), w).alias("wins_before"))


@query(BOUTS + f"""SELECT fight_id, fighter, round(coalesce(list_reduce(l, lambda a, x: a * (1 - 0.206) + x * 0.206), 0), 9) AS ewma_won FROM (
SELECT fight_id, fighter, list(CAST(won AS DOUBLE)) FILTER (won IS NOT NULL) OVER {BEFORE} AS l FROM sides)""")
def ewma_before(spark, sf_dir) -> DataFrame:
    rows = sides(spark, sf_dir).select("fight_id", "event_date", "fighter", F.col("won").cast("double").alias("won"))
    return history.ewma_before(rows, {"won": "ewma_won"}).select("fight_id", "fighter", F.round("ewma_won", 9).alias("ewma_won"))


@query(BOUTS + """, runs AS (SELECT *, sum(CASE WHEN won = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY fighter ORDER BY event_date, fight_id) AS run FROM sides),
lengths AS (SELECT *, sum(coalesce(won, 0)) OVER (PARTITION BY fighter, run ORDER BY event_date, fight_id) AS n FROM runs)
SELECT fight_id, fighter, CAST(coalesce(lag(n) OVER (PARTITION BY fighter ORDER BY event_date, fight_id), 0) AS BIGINT) AS win_streak FROM lengths""")
def streaks_before(spark, sf_dir) -> DataFrame:
    return history.with_streaks(sides(spark, sf_dir)).select("fight_id", "fighter", "win_streak")


@query(BOUTS + """, gaps AS (SELECT fight_id, fighter, event_date - lag(event_date) OVER (PARTITION BY fighter ORDER BY event_date, fight_id) AS d FROM sides)
SELECT fight_id, fighter, CAST(d AS BIGINT) AS days_since, round(ln(1 + d), 9) AS log_days, CAST(d < 60 AS INT) AS short_notice, CAST(d > 365 AS INT) AS comeback FROM gaps""")
def layoff_features(spark, sf_dir) -> DataFrame:
    """All null for a debut."""
    s = sides(spark, sf_dir)
    d = F.datediff("event_date", F.lag("event_date").over(history.ordered("fighter"))).cast("long")
    return s.select("fight_id", "fighter", d.alias("days_since")).select(
        "fight_id", "fighter", "days_since", F.round(F.log1p(F.col("days_since").cast("double")), 9).alias("log_days"),
        (F.col("days_since") < 60).cast("int").alias("short_notice"), (F.col("days_since") > 365).cast("int").alias("comeback"),
    )


@query(BOUTS + """SELECT fight_id, fighter, count(*) OVER (PARTITION BY fighter, division ORDER BY event_date, fight_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS division_bouts FROM sides""")
def division_count_before(spark, sf_dir) -> DataFrame:
    return sides(spark, sf_dir).select("fight_id", "fighter", F.count("*").over(history.before("fighter", "division")).alias("division_bouts"))


@query(BOUTS + f"""SELECT fight_id, fighter, CASE WHEN len(l) >= 3 THEN list_sum(l[-3:]) / 3::DOUBLE END AS last3 FROM (
SELECT fight_id, fighter, list(won) FILTER (won IS NOT NULL) OVER {BEFORE} AS l FROM sides)""")
def rolling_last3_nonnull(spark, sf_dir) -> DataFrame:
    listed = history.last_values(sides(spark, sf_dir), ["won"], 3)
    return listed.select("fight_id", "fighter", history.mean_of_last("last_won", 3).alias("last3"))


@query(BOUTS + """SELECT fight_id, fighter_a, fighter_b, CAST(row_number() OVER w > 1 AS INT) AS rematch, first(winner) OVER w AS first_winner
FROM bouts WINDOW w AS (PARTITION BY fighter_a, fighter_b ORDER BY event_date, fight_id)""")
def rematch_flags(spark, sf_dir) -> DataFrame:
    w = history.ordered("fighter_a", "fighter_b")
    return bouts(spark, sf_dir).select(
        "fight_id", "fighter_a", "fighter_b", (F.row_number().over(w) > 1).cast("int").alias("rematch"), F.first("winner").over(w).alias("first_winner")
    )


@query(BOUTS + """, r AS (SELECT fight_id, count(*) OVER w AS n, coalesce(sum(CAST(method IN ('KO/TKO', 'Submission') AS INT)) OVER w, 0) AS s FROM bouts
WINDOW w AS (PARTITION BY division ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT fight_id, n AS bouts_before, (s + 25) / (n + 50)::DOUBLE AS finish_rate FROM r""")
def division_rate_asof(spark, sf_dir) -> DataFrame:
    """Bouts fold to days before the window: a division's days are few, however many bouts it has."""
    b = bouts(spark, sf_dir)
    own = career.rates_by_day(b, ["division"], {"finish": F.col("method").isin("KO/TKO", "Submission")})
    met = b.join(own, ["division", "event_date"])
    return met.select("fight_id", F.col("n").alias("bouts_before"), history.shrunk(F.col("finish"), F.col("n"), F.lit(0.5)).alias("finish_rate"))


@query(BOUTS + """, k AS (SELECT *, md5(CAST(fight_id AS VARCHAR)) AS h FROM bouts)
SELECT fight_id, right(h, 1) IN ('0','2','4','6','8','a','c','e') AS kept,
CASE WHEN kept THEN fighter_a ELSE fighter_b END AS side_1, CASE WHEN kept THEN fighter_b ELSE fighter_a END AS side_2 FROM k""")
def orientation_swap(spark, sf_dir) -> DataFrame:
    kept = F.conv(F.right(F.md5(F.col("fight_id").cast("string").cast("binary")), F.lit(1)), 16, 10).cast("int") % 2 == 0
    b = bouts(spark, sf_dir).withColumn("kept", kept)
    return b.select(
        "fight_id", "kept", F.when(F.col("kept"), F.col("fighter_a")).otherwise(F.col("fighter_b")).alias("side_1"),
        F.when(F.col("kept"), F.col("fighter_b")).otherwise(F.col("fighter_a")).alias("side_2"),
    )


def _price(fighter):
    k = F.col("fight_id") * 37 + F.col(fighter)
    return F.when(k % 2 == 0, -(90 + k % 300)).otherwise(90 + k % 300)


@query(BOUTS + """, k AS (SELECT fight_id, fight_id * 37 + fighter_a AS ka, fight_id * 37 + fighter_b AS kb FROM bouts),
m AS (SELECT fight_id, CASE WHEN ka % 2 = 0 THEN -(90 + ka % 300) ELSE 90 + ka % 300 END AS a, CASE WHEN kb % 2 = 0 THEN -(90 + kb % 300) ELSE 90 + kb % 300 END AS b FROM k),
p AS (SELECT fight_id, CASE WHEN a <= -100 THEN -a / (-a + 100)::DOUBLE WHEN a >= 100 THEN 100 / (a + 100)::DOUBLE END AS pa,
CASE WHEN b <= -100 THEN -b / (-b + 100)::DOUBLE WHEN b >= 100 THEN 100 / (b + 100)::DOUBLE END AS pb FROM m)
SELECT fight_id, pa AS implied_a, pb AS implied_b, pa / (pa + pb) AS fair_a FROM p""")
def odds_devig(spark, sf_dir) -> DataFrame:
    p = bouts(spark, sf_dir).select("fight_id", implied_probability(_price("fighter_a")).alias("pa"), implied_probability(_price("fighter_b")).alias("pb"))
    return p.select("fight_id", F.col("pa").alias("implied_a"), F.col("pb").alias("implied_b"), devig(F.col("pa"), F.col("pb")).alias("fair_a"))


@query(BOUTS + "SELECT fighter, min(event_date) AS debut, max(event_date) AS latest FROM sides GROUP BY fighter")
def debut_date(spark, sf_dir) -> DataFrame:
    return sides(spark, sf_dir).groupBy("fighter").agg(F.min("event_date").alias("debut"), F.max("event_date").alias("latest"))


@query(BOUTS + "SELECT division, count(DISTINCT (fighter_a, fighter_b)) AS pairs, count(*) AS bouts FROM bouts GROUP BY division")
def distinct_pair_count(spark, sf_dir) -> DataFrame:
    """Bouts fold to pairs before the distinct count."""
    pairs = bouts(spark, sf_dir).groupBy("division", "fighter_a", "fighter_b").agg(F.count("*").alias("n"))
    return pairs.groupBy("division").agg(F.count("*").alias("pairs"), F.sum("n").alias("bouts"))


@query(BOUTS + """, years AS (SELECT unnest(range((SELECT min(year(event_date)) FROM bouts), (SELECT max(year(event_date)) FROM bouts) + 1)) AS y),
n AS (SELECT year(event_date) AS y, count(*) AS n, count(winner) AS decided FROM bouts GROUP BY ALL)
SELECT CAST(y AS INT) AS year, coalesce(n, 0) AS bouts, coalesce(decided, 0) AS decided FROM years LEFT JOIN n USING (y)""")
def coverage_by_year(spark, sf_dir) -> DataFrame:
    """Every year between the first and the last, those without bouts included."""
    n = bouts(spark, sf_dir).groupBy(F.year("event_date").alias("year")).agg(F.count("*").alias("n"), F.count("winner").alias("d"))
    years = n.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("bouts"), F.coalesce("d", F.lit(0)).alias("decided"))


@query(BOUTS + """SELECT loser, winner, count(*) AS weight, min(event_date) AS first_date FROM (
SELECT CASE WHEN winner = fighter_a THEN fighter_b ELSE fighter_a END AS loser, winner, event_date FROM bouts WHERE winner IS NOT NULL) GROUP BY ALL""")
def graph_edges(spark, sf_dir) -> DataFrame:
    """Loser to winner; rematches add weight and keep the earliest date."""
    b = bouts(spark, sf_dir).filter("winner is not null")
    loser = F.when(F.col("winner") == F.col("fighter_a"), F.col("fighter_b")).otherwise(F.col("fighter_a"))
    return b.groupBy(loser.alias("loser"), "winner").agg(F.count("*").alias("weight"), F.min("event_date").alias("first_date"))


PREDICTED = BOUTS + """, predicted AS (SELECT division, ((fight_id * 7919) % 1000) / 1000.0::DOUBLE AS p, CAST(winner = fighter_a AS INT) AS y FROM bouts WHERE winner IS NOT NULL)
"""


def predicted(spark, sf_dir) -> DataFrame:
    """A prediction made up from the bout's id, and the outcome for fighter_a."""
    b = bouts(spark, sf_dir).filter("winner is not null")
    return b.select("division", ((F.col("fight_id") * 7919) % 1000 / 1000.0).alias("p"), (F.col("winner") == F.col("fighter_a")).cast("int").alias("y"))


@query(PREDICTED + """SELECT division, count(*) AS n, round(avg(pow(p - y, 2)), 9) AS brier, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)), 9) AS accuracy
FROM predicted GROUP BY division""")
def brier_accuracy_by_slice(spark, sf_dir) -> DataFrame:
    out = evaluation.brier_accuracy(predicted(spark, sf_dir), "division")
    return out.select("division", "n", F.round("brier", 9).alias("brier"), F.round("accuracy", 9).alias("accuracy"))


@query(PREDICTED + """, r AS (SELECT *, rank() OVER (PARTITION BY division ORDER BY p) + (count(*) OVER (PARTITION BY division, p) - 1) / 2.0::DOUBLE AS rk FROM predicted)
SELECT division, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY division""")
def auc_by_slice(spark, sf_dir) -> DataFrame:
    return evaluation.auc(predicted(spark, sf_dir), "division").select("division", "auc")


@query(PREDICTED + "SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM predicted GROUP BY ALL")
def calibration_curve(spark, sf_dir) -> DataFrame:
    return evaluation.calibration(predicted(spark, sf_dir)).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query(PREDICTED + """, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM predicted GROUP BY ALL)
SELECT round(sum(n * gap) / sum(n), 9) AS ece FROM b""")
def ece(spark, sf_dir) -> DataFrame:
    return evaluation.expected_calibration_error(predicted(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_key_projection(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT user_id, event_id, ts, event_type, value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_state_per_key(spark, sf_dir) -> DataFrame:
    """A struct maximum: partly aggregated before the shuffle, no sort."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("s"))
    return e.select("user_id", "s.event_id", "s.ts", "s.event_type", "s.value")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def gap_not_in(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""WITH r AS (SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL),
t AS (SELECT cents FROM r ORDER BY cents DESC, l_suppkey LIMIT 30)
SELECT round((SELECT sum(cents) FROM t) / (SELECT sum(cents) FROM r)::DOUBLE, 9) AS top_share""")
def top_share(spark, sf_dir) -> DataFrame:
    """The share of all revenue that the 30 largest suppliers hold."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    top = r.orderBy(F.desc("cents"), "l_suppkey").limit(30).agg(F.sum("cents").alias("t"))
    return r.agg(F.sum("cents").alias("a")).join(F.broadcast(top)).select(F.round(F.col("t") / F.col("a").cast("double"), 9).alias("top_share"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' ELSE 'returned' END AS reason, count(*) AS copies
FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08 OR l_returnflag = 'R' GROUP BY ALL""")
def rejected_rows(spark, sf_dir) -> DataFrame:
    """Rows that break a rule, with the first rule they break."""
    reason = F.when(F.col("l_quantity") > 45, "quantity").when(F.col("l_discount") > 0.08, "discount").when(F.col("l_returnflag") == "R", "returned")
    rows = table(spark, sf_dir, "lineitem").withColumn("reason", reason).filter("reason is not null")
    return rows.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "reason").agg(F.count("*").alias("copies"))
