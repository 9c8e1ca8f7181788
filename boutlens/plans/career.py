"""Queries of the state before each bout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.operators import career, history
from boutlens.plans.base import BEFORE, BOUTS, RATED, ROUNDS, STATS, rated, rounds, seconds, stats
from boutlens.plans.bouts import bouts, sides
from boutlens.plans.registry import query

_MET = STATS + """, met AS (SELECT a.*, b.landed AS opp_landed, b.attempted AS opp_attempted, b.td_landed AS opp_td_landed, b.td_attempted AS opp_td_attempted, b.control AS opp_control
  FROM stats a LEFT JOIN stats b ON a.fight_id = b.fight_id AND a.opponent = b.fighter)
"""
_COUNTERS = [*career.COUNTERS, *(f"opp_{c}" for c in career.COUNTERS), "seconds"]
_TOTALS = _MET + f""", totals AS (SELECT fight_id, fighter, opponent, count(*) OVER w AS bouts_before,
{', '.join(f"CAST(coalesce(sum({c}) OVER w, 0) AS BIGINT) AS {c}_before" for c in _COUNTERS)} FROM met WINDOW w AS {BEFORE})
"""
_AVERAGES = _TOTALS + """, averages AS (SELECT fight_id, fighter, opponent, bouts_before,
  CASE WHEN seconds_before > 0 THEN landed_before / (seconds_before / 60.0::DOUBLE) ELSE 0.0::DOUBLE END AS landed_per_minute,
  CASE WHEN bouts_before > 0 THEN td_landed_before / bouts_before::DOUBLE ELSE 0.0::DOUBLE END AS td_rate,
  CASE WHEN td_attempted_before > 0 THEN td_landed_before / td_attempted_before::DOUBLE END AS td_accuracy,
  CASE WHEN opp_td_attempted_before > 0 THEN 1 - opp_td_landed_before / opp_td_attempted_before::DOUBLE END AS td_defense,
  CASE WHEN opp_attempted_before > 0 THEN 1 - opp_landed_before / opp_attempted_before::DOUBLE END AS strike_defense,
  CASE WHEN bouts_before > 0 THEN control_before / bouts_before::DOUBLE ELSE 0.0::DOUBLE END AS control_per_bout FROM totals),
performance AS (SELECT a.fight_id, a.fighter, a.bouts_before, a.landed_per_minute, a.td_rate, a.td_accuracy, a.td_defense, a.strike_defense, a.control_per_bout,
  coalesce(a.landed_per_minute / nullif(CASE WHEN o.bouts_before > 0 THEN o.landed_per_minute END, 0), a.landed_per_minute) AS adj_landed,
  coalesce(a.td_rate / nullif(CASE WHEN o.bouts_before > 0 THEN o.td_rate END, 0), a.td_rate) AS adj_td,
  coalesce(coalesce(a.strike_defense, 0) / nullif(CASE WHEN o.bouts_before > 0 THEN o.strike_defense END, 0), coalesce(a.strike_defense, 0)) AS adj_strike_defense,
  coalesce(a.control_per_bout / nullif(CASE WHEN o.bouts_before > 0 THEN o.control_per_bout END, 0), a.control_per_bout) AS adj_control
  FROM averages a LEFT JOIN averages o ON a.fight_id = o.fight_id AND a.opponent = o.fighter WHERE a.bouts_before >= 1)
"""


@query(BOUTS + _TOTALS + f"SELECT fight_id, fighter, bouts_before, {', '.join(f'{c}_before' for c in _COUNTERS)} FROM totals")
def career_totals_before(spark, sf_dir) -> DataFrame:
    return career.totals_before(stats(spark, sf_dir)).drop("opponent", "event_date")


@query(BOUTS + _AVERAGES + "SELECT * FROM performance")
def performance_features(spark, sf_dir) -> DataFrame:
    """Career averages, also over the opponent's, from a fighter's second bout on."""
    return career.performance(stats(spark, sf_dir))


_MEANS = career.AVERAGES
_SHRUNK = _AVERAGES + f""", means AS (SELECT {', '.join(f'avg({c}) AS mean_{c}' for c in _MEANS)} FROM performance)
"""


@query(BOUTS + _SHRUNK + f"""SELECT fight_id, fighter, bouts_before, {', '.join(f"round(mean_{c} + ({c} - mean_{c}) * least(bouts_before / 5.0::DOUBLE, 1), 9) AS {c}" for c in _MEANS)} FROM performance, means""")
def shrinkage_to_league_mean(spark, sf_dir) -> DataFrame:
    own = career.performance(stats(spark, sf_dir)).select("fight_id", "fighter", "bouts_before", *_MEANS)
    return career.shrink_to_league(own, _MEANS).select("fight_id", "fighter", "bouts_before", *(F.round(c, 9).alias(c) for c in _MEANS))


@query(BOUTS + _MET + f""", r AS (SELECT fight_id, fighter, event_date, landed / (seconds / 60.0::DOUBLE) AS v, CASE WHEN td_attempted > 0 THEN td_landed / td_attempted::DOUBLE END AS t FROM met WHERE seconds > 0
UNION ALL SELECT fight_id, fighter, event_date, NULL, CASE WHEN td_attempted > 0 THEN td_landed / td_attempted::DOUBLE END FROM met WHERE seconds <= 0),
l AS (SELECT fight_id, fighter, list(v) FILTER (v IS NOT NULL) OVER {BEFORE} AS v, list(t) FILTER (t IS NOT NULL) OVER {BEFORE} AS t FROM r)
SELECT fight_id, fighter, round(coalesce(list_reduce(v, lambda a, x: a * (1 - 0.206) + x * 0.206), 0), 9) AS landed_ewma,
round(coalesce(list_reduce(t, lambda a, x: a * (1 - 0.206) + x * 0.206), 0), 9) AS td_accuracy_ewma FROM l""")
def rate_ewma_before(spark, sf_dir) -> DataFrame:
    """Weighted means of the rates of earlier bouts, in one pass over each fighter's bouts."""
    rates = career.bout_rates(stats(spark, sf_dir)).select("fight_id", "event_date", "fighter", "landed_per_minute", "td_accuracy")
    out = history.ewma_before(rates, {"landed_per_minute": "landed_ewma", "td_accuracy": "td_accuracy_ewma"})
    return out.select("fight_id", "fighter", F.round("landed_ewma", 9).alias("landed_ewma"), F.round("td_accuracy_ewma", 9).alias("td_accuracy_ewma"))


_SNAPSHOT = RATED + f""", s AS (SELECT r.*, o.rating AS opponent_rating, coalesce(r.won, 0) AS w, 1 - coalesce(r.won, 0) AS l,
  CASE WHEN r.fight_id % 13 = 0 THEN 900 ELSE (r.fight_id % 3) * 300 + (r.fight_id % 5) * 60 + (r.fight_id * 7) % 60 END AS seconds,
  CAST(r.method IN ('KO/TKO', 'TKO') AS INT) AS ko, CAST(r.method IN ('Submission', 'SUB') AS INT) AS sub
  FROM rated r JOIN rated o ON r.fight_id = o.fight_id AND r.opponent = o.fighter),
runs AS (SELECT *, sum(l) OVER (PARTITION BY fighter ORDER BY event_date, fight_id) AS wr, sum(w) OVER (PARTITION BY fighter ORDER BY event_date, fight_id) AS lr FROM s),
lens AS (SELECT *, sum(w) OVER (PARTITION BY fighter, wr ORDER BY event_date, fight_id) AS wn, sum(l) OVER (PARTITION BY fighter, lr ORDER BY event_date, fight_id) AS ln FROM runs),
t AS (SELECT fight_id, fighter, event_date, CAST(coalesce(lag(wn) OVER o, 0) AS BIGINT) AS win_streak, CAST(coalesce(lag(ln) OVER o, 0) AS BIGINT) AS loss_streak,
  CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS wins, CAST(coalesce(sum(l) OVER b, 0) AS BIGINT) AS losses, coalesce(sum(w * ko) OVER b, 0) AS kw, coalesce(sum(w * sub) OVER b, 0) AS sw,
  coalesce(sum(l * ko) OVER b, 0) AS kl, coalesce(sum(l * sub) OVER b, 0) AS sl, coalesce(sum(seconds) OVER b, 0) AS cage, event_date - lag(event_date) OVER o AS days,
  (event_date - min(event_date) OVER b) / 365.25::DOUBLE AS span, coalesce(avg(opponent_rating) OVER b, 1500) AS opp,
  CASE WHEN count(rating) OVER r >= 2 THEN last_value(rating) OVER r - first_value(rating) OVER r END AS momentum,
  count(*) OVER (PARTITION BY fighter, division ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS division_bouts FROM lens
  WINDOW o AS (PARTITION BY fighter ORDER BY event_date, fight_id), b AS {BEFORE}, r AS (PARTITION BY fighter ORDER BY event_date, fight_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
"""


@query(BOUTS + _SNAPSHOT + """SELECT fight_id, fighter, win_streak, loss_streak, CASE WHEN wins + losses > 0 THEN wins / (wins + losses)::DOUBLE ELSE 0.5::DOUBLE END AS win_pct, wins + losses AS bouts,
CAST(days AS BIGINT) AS days_since_last, CASE WHEN wins > 0 THEN kw / wins::DOUBLE ELSE 0.0::DOUBLE END AS ko_win_rate, CASE WHEN wins > 0 THEN sw / wins::DOUBLE ELSE 0.0::DOUBLE END AS sub_win_rate,
CASE WHEN losses > 0 THEN kl / losses::DOUBLE ELSE 0.0::DOUBLE END AS ko_loss_rate, CASE WHEN losses > 0 THEN sl / losses::DOUBLE ELSE 0.0::DOUBLE END AS sub_loss_rate,
cage / 60.0::DOUBLE AS cage_minutes, CASE WHEN wins + losses > 0 THEN cage / (wins + losses)::DOUBLE END AS avg_seconds, division_bouts, CAST(wins + losses = 0 AS INT) AS is_debut,
CASE WHEN span > 0.5 THEN (wins + losses) / span END AS bouts_per_year, CAST(opp AS DOUBLE) AS avg_opponent_rating, momentum FROM t""")
def career_snapshot(spark, sf_dir) -> DataFrame:
    """Streaks, rates, spans and the opponents' strength before each bout; ratings are made up from the ids."""
    own = rated(spark, sf_dir)
    other = own.select("fight_id", F.col("fighter").alias("opponent"), F.col("rating").alias("opponent_rating"))
    return career.snapshot(own.join(other, ["fight_id", "opponent"]).withColumn("seconds", seconds(F.col("fight_id"))))


def _pace_sql(own: bool) -> str:
    cols = {"strikes": "s", "td": "t", "variance": "v", "first_round": "f"}
    parts = ", ".join(f"round(list_sum({c}[-10:]) / nullif(least(len({c if own else 's'}), 10), 0), 9) AS pace_{n}" for n, c in cols.items())
    lists = ", ".join(f"coalesce(list({c}) FILTER ({c} IS NOT NULL) OVER {BEFORE}, []) AS {c}" for c in cols.values())
    return BOUTS + ROUNDS + f""", per AS (SELECT fight_id, fighter, count(*) AS n, arg_min(landed, round) AS s1, arg_max(landed, round) AS sn, arg_min(td_landed, round) AS t1, arg_max(td_landed, round) AS tn, var_pop(landed) AS vp FROM rounds GROUP BY ALL),
j AS (SELECT s.fight_id, s.event_date, s.fighter, CASE WHEN n >= 2 AND s1 > 0 THEN sn / s1::DOUBLE END AS s, CASE WHEN n >= 2 AND t1 > 0 THEN tn / t1::DOUBLE END AS t, CASE WHEN n >= 2 THEN vp END AS v, CASE WHEN n >= 2 THEN s1::DOUBLE END AS f
  FROM sides s LEFT JOIN per p ON s.fight_id = p.fight_id AND s.fighter = p.fighter),
k AS (SELECT fight_id, fighter, {lists} FROM j) SELECT fight_id, fighter, {parts.replace('list_sum(', 'coalesce(list_sum(').replace('[-10:])', '[-10:]), 0)')} FROM k"""


def _pace(spark, sf_dir, own: bool) -> DataFrame:
    out = career.pace(rounds(spark, sf_dir), sides(spark, sf_dir), own)
    return out.select("fight_id", "fighter", *(F.round(c, 9).alias(c) for c in out.columns if c.startswith("pace_")))


@query(_pace_sql(False))
def pace_decay_before(spark, sf_dir) -> DataFrame:
    """All means over the number of strike ratios, as the reference has them."""
    return _pace(spark, sf_dir, False)


@query(_pace_sql(True))
def pace_decay_own_counts(spark, sf_dir) -> DataFrame:
    """Each mean over its own list."""
    return _pace(spark, sf_dir, True)


@query(BOUTS + RATED + f""", l AS (SELECT fight_id, fighter, coalesce(list(r ORDER BY d, f), []) AS l FROM (SELECT a.fight_id, a.fighter, b.rating AS r, b.event_date AS d, b.fight_id AS f
FROM rated a LEFT JOIN rated b ON a.fighter = b.fighter AND b.event_date < a.event_date) GROUP BY ALL)
SELECT fight_id, fighter, CASE WHEN len(l) >= 6 THEN (l[-1] - l[-6]) / 5 END AS velocity FROM l""")
def rating_velocity(spark, sf_dir) -> DataFrame:
    return career.velocity(rated(spark, sf_dir))


@query(BOUTS + RATED + """, d AS (SELECT *, dense_rank() OVER (PARTITION BY fighter ORDER BY event_date DESC) AS r FROM rated WHERE event_date < DATE '2000-01-01')
SELECT fighter, fight_id, event_date, rating, CAST(r AS INT) AS back FROM d WHERE r <= 6""")
def last_n_before(spark, sf_dir) -> DataFrame:
    """Ratings of each fighter's last six days before a date."""
    return history.last_days(rated(spark, sf_dir).filter(F.col("event_date") < F.lit("2000-01-01").cast("date")), 6).select("fighter", "fight_id", "event_date", "rating", "back")


@query(BOUTS + RATED + """SELECT fight_id, fighter, rating, won, count(*) OVER w AS bouts_before, CASE WHEN count(*) OVER w < 5 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS k,
CASE WHEN won IS NULL THEN 0.5::DOUBLE WHEN method = 'KO/TKO' THEN 1.2::DOUBLE WHEN method = 'Submission' THEN 1.1::DOUBLE WHEN method = 'DQ' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS margin,
coalesce(CASE WHEN gap > 270 THEN least((gap - 270) / 30.0::DOUBLE * 0.1::DOUBLE, 0.5::DOUBLE) END, 0.0::DOUBLE) AS regression,
1500 + (rating - 1500) * least((count(*) OVER w + 1) / 5.0::DOUBLE, 1) AS shown FROM (SELECT *, event_date - lag(event_date) OVER (PARTITION BY fighter ORDER BY event_date, fight_id) AS gap FROM rated)
WINDOW w AS """ + BEFORE)
def rating_expressions(spark, sf_dir) -> DataFrame:
    """Each bout's factors of the rating fold: experience, margin, inactivity, shrinkage."""
    from boutlens.functions import odds as rating

    w = history.before("fighter")
    gap = F.datediff("event_date", F.lag("event_date").over(history.ordered("fighter")))
    n = F.count("*").over(w)
    return rated(spark, sf_dir).select(
        "fight_id", "fighter", "rating", "won", n.alias("bouts_before"), rating.k_factor(n).alias("k"),
        rating.margin(F.col("method"), F.lit(None), F.col("won").isNull()).alias("margin"), F.coalesce(rating.inactivity(gap), F.lit(0.0)).alias("regression"),
        rating.shown(F.col("rating"), n + 1).alias("shown"),
    )


_FINISH = "CAST(method IN ('KO/TKO', 'Submission') AS BIGINT)"


def _asof_sql(keys: str, columns: str, source: str) -> str:
    return f""", days AS (SELECT {keys}, event_date, count(*) AS n, sum(fin) AS fin, sum(dec) AS dec FROM {source} GROUP BY ALL),
w AS (SELECT {keys}, event_date, CAST(coalesce(sum(n) OVER v, 0) AS BIGINT) AS n, CAST(coalesce(sum(fin) OVER v, 0) AS BIGINT) AS fin, CAST(coalesce(sum(dec) OVER v, 0) AS BIGINT) AS dec FROM days
WINDOW v AS (PARTITION BY {keys} ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) {columns}"""


@query(BOUTS + f""", judged AS (SELECT fight_id, event_date, CASE WHEN fight_id % 17 <> 0 THEN fight_id % 40 END AS referee, {_FINISH} AS fin, CAST(method = 'Decision' AS BIGINT) AS dec FROM bouts),
g AS (SELECT sum(fin) / count(*)::DOUBLE AS f, sum(dec) / count(*)::DOUBLE AS d, sum(1 - fin - dec) / count(*)::DOUBLE AS x FROM judged)
""" + _asof_sql("referee", """SELECT j.fight_id, j.referee, coalesce(w.n, 0) AS n, round((coalesce(w.fin, 0) + 50 * g.f) / (coalesce(w.n, 0) + 50), 9) AS finish_rate,
round((coalesce(w.dec, 0) + 50 * g.d) / (coalesce(w.n, 0) + 50), 9) AS decision_rate, round((coalesce(w.n - w.fin - w.dec, 0) + 50 * g.x) / (coalesce(w.n, 0) + 50), 9) AS no_action_rate
FROM g, judged j LEFT JOIN w ON j.referee = w.referee AND j.event_date = w.event_date""", "judged WHERE referee IS NOT NULL"))
def referee_rates_asof(spark, sf_dir) -> DataFrame:
    """A referee's outcome rates on earlier days, shrunk to the rates of all bouts; unknown referees get those."""
    from boutlens.functions.odds import outcome

    kind = outcome(F.col("method"))
    b = bouts(spark, sf_dir).withColumn("referee", F.when(F.col("fight_id") % 17 != 0, F.col("fight_id") % 40)).withColumn("kind", kind)
    kinds = ["finish", "decision", "no_action"]
    overall = b.agg(*((F.count_if(F.col("kind") == k) / F.count("*")).alias(f"g_{k}") for k in kinds))
    own = career.rates_by_day(b.filter("referee is not null"), ["referee"], {k: F.col("kind") == k for k in kinds})
    met = b.join(own, ["referee", "event_date"], "left").join(F.broadcast(overall)).fillna(0, ["n", *kinds])
    rate = lambda k: F.round(history.shrunk(F.col(k), F.col("n"), F.col(f"g_{k}")), 9).alias(f"{k}_rate")
    return met.select("fight_id", "referee", "n", *(rate(k) for k in kinds))


@query(BOUTS + f""", cohort AS (SELECT fight_id, event_date, CASE WHEN fight_id % 11 = 0 THEN 'UNKNOWN' ELSE CASE (fight_id % 25) % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'BR' WHEN 2 THEN 'AU' WHEN 3 THEN 'ASIA-PACIFIC' WHEN 4 THEN 'EU-OTHER' ELSE 'UNKNOWN' END END AS bucket,
CASE WHEN event_date < DATE '2017-01-01' THEN 'pre_2017' ELSE 'unified_post_2017' END AS regime, {_FINISH} AS fin, CAST(method = 'Decision' AS BIGINT) AS dec FROM bouts),
g AS (SELECT sum(fin) / count(*)::DOUBLE AS f FROM cohort)
""" + _asof_sql("bucket, regime", """SELECT c.fight_id, c.bucket, c.regime, w.n, round((w.fin + 50 * g.f) / (w.n + 50), 9) AS finish_rate, round((w.dec + 50 * (1 - g.f)) / (w.n + 50), 9) AS decision_rate
FROM g, cohort c JOIN w ON c.bucket = w.bucket AND c.regime = w.regime AND c.event_date = w.event_date""", "cohort"))
def cohort_rates_asof(spark, sf_dir) -> DataFrame:
    """Outcome rates of a country's bucket under a scoring regime, on earlier days."""
    from boutlens.functions.dates import scoring_regime
    from boutlens.functions.odds import country_bucket, outcome
    from boutlens.plans.base import placed_bouts, venues

    kind = outcome(F.col("method"))
    b = placed_bouts(spark, sf_dir).join(venues(spark, sf_dir), "venue_id", "left")
    b = b.select("fight_id", "event_date", country_bucket(F.col("country")).alias("bucket"), scoring_regime(F.col("event_date")).alias("regime"), kind.alias("kind"))
    prior = b.agg((F.count_if(F.col("kind") == "finish") / F.count("*")).alias("g"))
    own = career.rates_by_day(b, ["bucket", "regime"], {k: F.col("kind") == k for k in ("finish", "decision")})
    met = b.join(own, ["bucket", "regime", "event_date"]).join(F.broadcast(prior))
    return met.select(
        "fight_id", "bucket", "regime", "n", F.round(history.shrunk(F.col("finish"), F.col("n"), F.col("g")), 9).alias("finish_rate"),
        F.round(history.shrunk(F.col("decision"), F.col("n"), 1 - F.col("g")), 9).alias("decision_rate"),
    )
