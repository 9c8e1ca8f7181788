"""Queries over measurements, prices, venues and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlens.functions import dates
from boutlens.functions import odds as fn
from boutlens.plans.base import BOUTS, ODDS, PHYSICALS, RATED, ROUNDS, VENUES, odds, physicals, placed_bouts, rated, rounds, stats, venues
from boutlens.plans.bouts import bouts, sides
from boutlens.plans.registry import query


@query(BOUTS + PHYSICALS + """, d AS (SELECT DISTINCT s.division, p.* FROM sides s JOIN physicals p USING (fighter) WHERE s.event_date < DATE '2000-01-01')
SELECT division, coalesce(median(height), 0) AS height, coalesce(median(reach), 0) AS reach, coalesce(median(height - 40), 0) AS leg FROM d GROUP BY ALL""")
def division_medians(spark, sf_dir) -> DataFrame:
    """Exact medians over the distinct fighters of each division before a date."""
    early = sides(spark, sf_dir).filter(F.col("event_date") < F.lit("2000-01-01").cast("date")).select("division", "fighter").distinct()
    met = early.join(physicals(spark, sf_dir), "fighter").withColumn("leg", F.col("height") - 40)
    return met.groupBy("division").agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in ("height", "reach", "leg")))


@query(BOUTS + PHYSICALS + "SELECT division, avg(reach) AS mean_reach FROM (SELECT DISTINCT division, fighter FROM sides) JOIN physicals USING (fighter) GROUP BY ALL")
def mean_reach_distinct(spark, sf_dir) -> DataFrame:
    own = sides(spark, sf_dir).select("division", "fighter").distinct()
    return own.join(physicals(spark, sf_dir), "fighter").groupBy("division").agg(F.avg("reach").alias("mean_reach"))


@query(BOUTS + PHYSICALS + "SELECT division, avg(reach) AS mean_reach FROM sides JOIN physicals USING (fighter) GROUP BY ALL")
def mean_reach_weighted(spark, sf_dir) -> DataFrame:
    """Every bout counts: sides fold to fighters before the join."""
    own = sides(spark, sf_dir).groupBy("division", "fighter").agg(F.count("*").alias("n")).join(physicals(spark, sf_dir), "fighter").filter("reach is not null")
    return own.groupBy("division").agg((F.sum(F.col("reach") * F.col("n")) / F.sum("n")).alias("mean_reach"))


@query(BOUTS + PHYSICALS + """, means AS (SELECT division, avg(reach) AS mean_reach FROM (SELECT DISTINCT division, fighter FROM sides) JOIN physicals USING (fighter) GROUP BY ALL)
SELECT b.fight_id, a.height - z.height AS height_diff, a.reach - z.reach AS reach_diff, (a.reach - z.reach) / nullif(m.mean_reach, 0) AS reach_diff_normalized,
(b.event_date - a.born) / 365.25::DOUBLE AS age_a, (b.event_date - z.born) / 365.25::DOUBLE AS age_b, (b.event_date - a.born) / 365.25::DOUBLE - (b.event_date - z.born) / 365.25::DOUBLE AS age_diff,
CAST(coalesce(nullif(a.stance, 'Switch'), 'Orthodox') = coalesce(nullif(z.stance, 'Switch'), 'Orthodox') AS DOUBLE) AS stance_matchup, 5.0::DOUBLE AS weight_class_ordinal
FROM bouts b JOIN physicals a ON b.fighter_a = a.fighter JOIN physicals z ON b.fighter_b = z.fighter JOIN means m USING (division)""")
def physical_differentials(spark, sf_dir) -> DataFrame:
    p = physicals(spark, sf_dir)
    a, b = (p.select(*(F.col(c).alias(f"{c}_{s}") for c in ("fighter", "height", "reach", "stance", "born"))) for s in "ab")
    means = mean_reach_distinct(spark, sf_dir)
    met = bouts(spark, sf_dir).join(a, "fighter_a").join(b, "fighter_b").join(F.broadcast(means), "division")
    age = lambda s: dates.years_between(F.col(f"born_{s}"), F.col("event_date"))
    return met.select(
        "fight_id", (F.col("height_a") - F.col("height_b")).alias("height_diff"), (F.col("reach_a") - F.col("reach_b")).alias("reach_diff"),
        fn.reach_over_mean(F.col("reach_a"), F.col("reach_b"), F.col("mean_reach")).alias("reach_diff_normalized"), age("a").alias("age_a"), age("b").alias("age_b"),
        (age("a") - age("b")).alias("age_diff"), fn.same_stance(F.col("stance_a"), F.col("stance_b")).alias("stance_matchup"), fn.division_ordinal(F.col("division")).alias("weight_class_ordinal"),
    )


_P = "CASE WHEN {0} <= -100 THEN -{0} / (-{0} + 100)::DOUBLE WHEN {0} >= 100 THEN 100 / ({0} + 100)::DOUBLE END"
_MARKET = ODDS + f""", prob AS (SELECT fight_id, fighter, {_P.format('opening')} AS o, ({_P.format('close_min')} + {_P.format('close_max')}) / 2 AS c FROM odds),
market AS (SELECT b.fight_id, b.fighter_a, b.fighter_b, a.o / (a.o + z.o) AS open_a, z.o / (z.o + a.o) AS open_b, a.c / (a.c + z.c) AS close_a, z.c / (z.c + a.c) AS close_b
  FROM bouts b LEFT JOIN prob a ON b.fight_id = a.fight_id AND b.fighter_a = a.fighter LEFT JOIN prob z ON b.fight_id = z.fight_id AND b.fighter_b = z.fighter)
"""


def market(spark, sf_dir) -> DataFrame:
    """Both sides' fair probabilities at opening and closing, null without a price."""
    p = odds(spark, sf_dir).select("fight_id", "fighter", fn.implied_probability(F.col("opening")).alias("o"), fn.closing_consensus(F.col("close_min"), F.col("close_max")).alias("c"))
    a, b = (p.select("fight_id", F.col("fighter").alias(f"fighter_{s}"), F.col("o").alias(f"o{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
    met = bouts(spark, sf_dir).join(a, ["fight_id", "fighter_a"], "left").join(b, ["fight_id", "fighter_b"], "left")
    fair = lambda x, y, name: fn.devig(F.col(x), F.col(y)).alias(name)
    return met.select("fight_id", "fighter_a", "fighter_b", fair("oa", "ob", "open_a"), fair("ob", "oa", "open_b"), fair("ca", "cb", "close_a"), fair("cb", "ca", "close_b"))


@query(BOUTS + _MARKET + "SELECT fight_id, open_a, open_b, close_a, close_b FROM market")
def fair_probabilities(spark, sf_dir) -> DataFrame:
    return market(spark, sf_dir).drop("fighter_a", "fighter_b")


@query(BOUTS + _MARKET + RATED + """SELECT m.fight_id, open_a - open_b AS opening_prob_diff, close_a - close_b AS closing_prob_diff, (close_a - open_a) - (close_b - open_b) AS line_movement_diff,
abs((close_a - open_a) - (close_b - open_b)) AS sharp_money_signal, round(close_a - 1 / (1 + pow(10.0::DOUBLE, (b.rating - a.rating) / 400)), 9) AS odds_elo_divergence
FROM market m JOIN rated a ON m.fight_id = a.fight_id AND m.fighter_a = a.fighter JOIN rated b ON m.fight_id = b.fight_id AND m.fighter_b = b.fighter""")
def odds_features(spark, sf_dir) -> DataFrame:
    """Market differentials; every one is null where one of its prices is."""
    r = rated(spark, sf_dir)
    a, b = (r.select("fight_id", F.col("fighter").alias(f"fighter_{s}"), F.col("rating").alias(f"r{s}")) for s in "ab")
    met = market(spark, sf_dir).join(a, ["fight_id", "fighter_a"]).join(b, ["fight_id", "fighter_b"])
    move = (F.col("close_a") - F.col("open_a")) - (F.col("close_b") - F.col("open_b"))
    return met.select(
        "fight_id", (F.col("open_a") - F.col("open_b")).alias("opening_prob_diff"), (F.col("close_a") - F.col("close_b")).alias("closing_prob_diff"), move.alias("line_movement_diff"),
        F.abs(move).alias("sharp_money_signal"), F.round(F.col("close_a") - fn.expected_score(F.col("ra"), F.col("rb")), 9).alias("odds_elo_divergence"),
    )


_HAVERSINE = "2 * {r} * asin(sqrt(pow(sin(radians(v.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - p.lon) / 2), 2)))"
_HOURS = "CASE {0}.zone WHEN 'UTC' THEN 0 WHEN 'Asia/Tokyo' THEN 9 WHEN 'America/Phoenix' THEN -7 WHEN 'Asia/Kolkata' THEN 5.5 WHEN 'Australia/Brisbane' THEN 10 END"


@query(BOUTS + VENUES + f""", s AS (SELECT fight_id, event_date, fighter_a AS fighter, venue_id FROM placed_bouts UNION ALL SELECT fight_id, event_date, fighter_b, venue_id FROM placed_bouts),
w AS (SELECT *, last_value(venue_id IGNORE NULLS) OVER (PARTITION BY fighter ORDER BY event_date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM s)
SELECT w.fight_id, w.fighter, w.prior AS prior_venue, round(CASE WHEN v.venue_id IS NULL THEN NULL WHEN p.venue_id IS NULL THEN 0 ELSE {_HAVERSINE.format(r=3958.7613)} END, 6) AS miles,
round(CASE WHEN v.venue_id IS NOT NULL AND p.venue_id IS NOT NULL THEN {_HAVERSINE.format(r=6371.0088)} END, 6) AS km,
CAST(CASE WHEN v.venue_id IS NULL THEN NULL WHEN p.venue_id IS NULL THEN 0 ELSE {_HOURS.format('v')} - {_HOURS.format('p')} END AS DOUBLE) AS tz_shift,
CAST(CASE WHEN v.venue_id IS NOT NULL AND p.venue_id IS NOT NULL THEN greatest(least({_HOURS.format('v')} - {_HOURS.format('p')}, 12), -12) END AS DOUBLE) AS tz_shift_clipped
FROM w LEFT JOIN venues v ON w.venue_id = v.venue_id LEFT JOIN venues p ON w.prior = p.venue_id""")
def travel_features(spark, sf_dir) -> DataFrame:
    """Distance and clock shift from the last known venue; a debut has 0 in the older form and null in the newer one."""
    b = placed_bouts(spark, sf_dir)
    s = b.select("fight_id", "event_date", "venue_id", F.explode(F.array("fighter_a", "fighter_b")).alias("fighter"))
    w = Window.partitionBy("fighter").orderBy("event_date", "fight_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("venue_id").isNotNull(), F.struct("venue_id", "event_date")), ignorenulls=True).over(w)
    s = s.withColumn("p", prior).select("fight_id", "event_date", "fighter", "venue_id", F.col("p.venue_id").alias("prior_venue"), F.col("p.event_date").alias("prior_date"))
    v = venues(spark, sf_dir).select("venue_id", "lat", "lon", "zone")
    before = v.select(F.col("venue_id").alias("prior_venue"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.col("zone").alias("pzone"))
    met = s.join(v, "venue_id", "left").join(before, "prior_venue", "left")
    here, known = F.col("zone").isNotNull(), F.col("pzone").isNotNull()
    way = lambda r: fn.great_circle(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"), r)
    shift = dates.zone_hours(F.col("zone"), F.col("event_date")) - dates.zone_hours(F.col("pzone"), F.col("prior_date"))
    return met.select(
        "fight_id", "fighter", "prior_venue", F.round(F.when(here, F.coalesce(way(fn.MILES), F.lit(0.0))), 6).alias("miles"), F.round(F.when(here & known, way(fn.KILOMETRES)), 6).alias("km"),
        F.when(here, F.coalesce(shift, F.lit(0.0))).alias("tz_shift"), F.when(here & known, fn.clipped(shift, 12.0)).alias("tz_shift_clipped"),
    )


_STYLES = RATED + """, styled AS (SELECT fight_id, fighter, opponent, won, CASE WHEN (fight_id * 13 + fighter * 7) % 121 - 60 > 30 THEN 'striker' WHEN (fight_id * 13 + fighter * 7) % 121 - 60 < -30 THEN 'grappler' ELSE 'balanced' END AS style FROM sides),
style_pairs AS (SELECT least(a.style, b.style) AS style_a, greatest(a.style, b.style) AS style_b, CASE WHEN a.style <= b.style THEN a.won ELSE b.won END AS first_won FROM styled a JOIN styled b ON a.fight_id = b.fight_id AND a.opponent = b.fighter AND a.fighter < b.fighter WHERE a.won IS NOT NULL)
"""


@query(BOUTS + _STYLES + """SELECT style_a, style_b, CAST(sum(first_won) AS BIGINT) AS a_wins, CAST(count(*) - sum(first_won) AS BIGINT) AS b_wins, count(*) AS total,
CASE WHEN count(*) >= 10 THEN sum(first_won) / count(*)::DOUBLE END AS a_win_pct, count(*) >= 10 AS sufficient FROM style_pairs GROUP BY ALL""")
def style_matchup_matrix(spark, sf_dir) -> DataFrame:
    """Wins by pair of styles; a rate only from ten bouts on. The domain ratings are made up from the ids."""
    gap = ((F.col("fight_id") * 13 + F.col("fighter") * 7) % 121 - 60).cast("double")
    s = sides(spark, sf_dir).select("fight_id", "fighter", "opponent", "won", fn.style(fn.style_index(gap, F.lit(0.0)), F.lit(0.0)).alias("style"))
    other = s.select("fight_id", F.col("fighter").alias("opponent"), F.col("style").alias("other"), F.col("won").alias("other_won"))
    met = s.filter("fighter < opponent and won is not null").join(other, ["fight_id", "opponent"])
    first = F.when(F.col("style") <= F.col("other"), F.col("won")).otherwise(F.col("other_won"))
    by = met.groupBy(F.least("style", "other").alias("style_a"), F.greatest("style", "other").alias("style_b")).agg(F.sum(first).alias("a_wins"), F.count("*").alias("total"))
    enough = F.col("total") >= 10
    return by.select("style_a", "style_b", "a_wins", (F.col("total") - F.col("a_wins")).alias("b_wins"), "total", F.when(enough, F.col("a_wins") / F.col("total")).alias("a_win_pct"), enough.alias("sufficient"))


@query(BOUTS + ROUNDS + "SELECT fighter, CAST(sum(landed) AS BIGINT) AS landed, CAST(sum(attempted) AS BIGINT) AS attempted, sum(landed) / nullif(sum(attempted), 0)::DOUBLE AS accuracy FROM rounds GROUP BY ALL")
def career_accuracy(spark, sf_dir) -> DataFrame:
    by = rounds(spark, sf_dir).groupBy("fighter").agg(F.sum("landed").alias("landed"), F.sum("attempted").alias("attempted"))
    return by.withColumn("accuracy", F.try_divide(F.col("landed"), F.col("attempted")))


@query(BOUTS + ROUNDS + """, s AS (SELECT b.fight_id, b.method, CAST(sum(landed) AS BIGINT) AS hits, CAST(sum(td_landed + control) AS BIGINT) AS holds FROM bouts b JOIN rounds r ON b.fight_id = r.fight_id GROUP BY ALL)
SELECT fight_id, CASE WHEN method = 'KO/TKO' THEN 1.0::DOUBLE WHEN method = 'Submission' THEN 0.0::DOUBLE WHEN hits + holds = 0 THEN 0.5::DOUBLE ELSE hits / (hits + holds)::DOUBLE END AS striking,
CASE WHEN method = 'KO/TKO' THEN 0.0::DOUBLE WHEN method = 'Submission' THEN 1.0::DOUBLE WHEN hits + holds = 0 THEN 0.5::DOUBLE ELSE 1 - hits / (hits + holds)::DOUBLE END AS grappling FROM s""")
def attribution_ratio(spark, sf_dir) -> DataFrame:
    from boutlens.operators.rating import attribution

    return attribution(bouts(spark, sf_dir), rounds(spark, sf_dir)).select("fight_id", "striking", "grappling")


@query(BOUTS + PHYSICALS + """, c AS (SELECT s.division, CASE WHEN year(s.event_date) < 2010 THEN 'pre-2010' WHEN year(s.event_date) < 2020 THEN '2010s' ELSE '2020s' END AS era, p.* FROM sides s JOIN physicals p USING (fighter)),
l AS (SELECT division, era, 'height' AS col, height IS NULL AS missing FROM c UNION ALL SELECT division, era, 'reach', reach IS NULL FROM c UNION ALL SELECT division, era, 'stance', stance IS NULL FROM c UNION ALL SELECT division, era, 'born', born IS NULL FROM c)
SELECT division, era, col, count(*) AS rows, count(*) FILTER (missing) AS missing, count(*) FILTER (missing) / count(*)::DOUBLE AS rate, count(*) FILTER (missing) / count(*)::DOUBLE > 0.1 AS biased FROM l GROUP BY ALL""")
def missingness_by_cohort(spark, sf_dir) -> DataFrame:
    """Missing measurements by division, era and column; a fighter counts once for each bout."""
    columns = ["height", "reach", "stance", "born"]
    met = sides(spark, sf_dir).select("fighter", "division", dates.era(F.col("event_date")).alias("era")).join(physicals(spark, sf_dir), "fighter")
    by = met.groupBy("division", "era").agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = by.unpivot(["division", "era", "rows"], columns, "col", "missing")
    return long.withColumns({"rate": F.col("missing") / F.col("rows"), "biased": F.col("missing") / F.col("rows") > 0.1})


@query(BOUTS + ODDS + """, c AS (SELECT b.fight_id, year(b.event_date) AS y, count(o.fighter) AS n FROM bouts b LEFT JOIN odds o ON b.fight_id = o.fight_id GROUP BY ALL),
p AS (SELECT y, count(*) AS total, count(*) FILTER (n = 2) AS priced FROM c GROUP BY ALL)
SELECT y AS year, total, priced, round(100 * priced / total::DOUBLE, 2) AS pct, (SELECT min(y) FROM p WHERE priced / total::DOUBLE >= 0.88) AS first_covered FROM p""")
def odds_coverage_by_year(spark, sf_dir) -> DataFrame:
    """Bouts with both prices, by year, and the first year in which enough have them."""
    priced = odds(spark, sf_dir).groupBy("fight_id").agg(F.count("*").alias("n"))
    met = bouts(spark, sf_dir).join(priced, "fight_id", "left")
    by = met.groupBy(F.year("event_date").alias("year")).agg(F.count("*").alias("total"), F.count_if(F.col("n") == 2).alias("priced"))
    first = by.agg(F.min(F.when(F.col("priced") / F.col("total") >= 0.88, F.col("year"))).alias("first_covered"))
    return by.withColumn("pct", F.round(100 * F.col("priced") / F.col("total"), 2)).join(F.broadcast(first))


@query(BOUTS + ODDS + """, n AS (SELECT fight_id, count(*) AS n FROM odds GROUP BY ALL), p AS (SELECT year(event_date) AS year, count(DISTINCT b.fight_id) AS bouts, count(DISTINCT n.fight_id) AS covered FROM bouts b LEFT JOIN n ON b.fight_id = n.fight_id GROUP BY ALL)
SELECT year, bouts, covered, greatest(0.5, covered / bouts::DOUBLE) AS reachable, covered / bouts::DOUBLE < 0.88 AS at_risk, CASE WHEN covered / bouts::DOUBLE >= 0.9 THEN 'full' WHEN covered / bouts::DOUBLE >= 0.85 THEN 'partial' ELSE 'thin' END AS verdict FROM p""")
def coverage_verdicts(spark, sf_dir) -> DataFrame:
    """Coverage with a floor, a risk flag and a label."""
    covered = odds(spark, sf_dir).select("fight_id").distinct().withColumn("has", F.lit(1))
    by = bouts(spark, sf_dir).join(covered, "fight_id", "left").groupBy(F.year("event_date").alias("year")).agg(F.count("*").alias("bouts"), F.count("has").alias("covered"))
    rate = F.col("covered") / F.col("bouts")
    return by.withColumns({"reachable": F.greatest(F.lit(0.5), rate), "at_risk": rate < 0.88, "verdict": F.when(rate >= 0.9, "full").when(rate >= 0.85, "partial").otherwise("thin")})


@query(BOUTS + """, early AS (SELECT fighter, min(event_date) AS first FROM sides GROUP BY ALL), old AS (
SELECT s.fighter, s.won, s.method, s.event_date, s.division FROM sides s JOIN early e ON s.fighter = e.fighter WHERE s.event_date < e.first + 700 AND s.division NOT LIKE '%AUTO%'),
r AS (SELECT fighter, count(*) AS n, count(*) FILTER (won = 1) AS w, count(*) FILTER (won = 0) AS l, count(*) FILTER (won IS NULL) AS d, count(*) FILTER (won = 1 AND method = 'KO/TKO') AS k,
count(*) FILTER (won = 1 AND method = 'Submission') AS s, count(*) FILTER (won = 1 AND method = 'Decision') AS c, max(event_date) - min(event_date) AS span, arg_max(division, (event_date, division)) AS last_division FROM old GROUP BY ALL)
SELECT fighter, n AS bouts, w AS wins, l AS losses, d AS draws, w / n::DOUBLE AS win_pct, CASE WHEN w > 0 THEN k / w::DOUBLE ELSE 0 END AS ko_rate, CASE WHEN w > 0 THEN s / w::DOUBLE ELSE 0 END AS sub_rate,
CASE WHEN w > 0 THEN c / w::DOUBLE ELSE 0 END AS decision_rate, CASE WHEN n >= 2 THEN span / 365.25::DOUBLE ELSE 0 END AS career_years, last_division,
greatest(1300, least(1700, 1500 + 100 * (w / n::DOUBLE - 0.5) + CASE fighter % 4 WHEN 0 THEN 50 WHEN 1 THEN 0 WHEN 2 THEN -25 ELSE -50 END + greatest(0, least(25, n / 20::DOUBLE * 25)))) AS seed FROM r""")
def early_career_records(spark, sf_dir) -> DataFrame:
    """Each fighter's record before a cutoff, some events left out, and the first rating that it gives."""
    from boutlens.operators.records import early_record

    s = sides(spark, sf_dir)
    first = s.groupBy("fighter").agg(F.date_add(F.min("event_date"), 700).alias("cutoff"))
    out = early_record(s.join(first, "fighter"), F.col("event_date") < F.col("cutoff"), "division", "%AUTO%")
    k = F.col("fighter") % 4
    tier = F.when(k == 0, "major").when(k == 1, "regional").when(k == 2, "local").otherwise("none")
    return out.withColumn("seed", fn.seed_rating(F.col("win_pct"), F.col("bouts"), tier))
