"""The whole feature matrix over the derived relations, beside the SQL that joins the same blocks one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.operators import assembly, career, graph, history, matrix
from boutlens.plans import base, profiles, queries, reports
from boutlens.plans import career as career_queries
from boutlens.plans.base import BEFORE, BOUTS, PHYSICALS, STATS
from boutlens.plans.bouts import bouts, materialised, sides
from boutlens.plans.registry import SQL, query

_RATES = {
    "sig_str_per_minute": "CASE WHEN {seconds} > 0 THEN {landed} / ({seconds} / 60.0::DOUBLE) END", "total_str_per_minute": "CASE WHEN {seconds} > 0 THEN {total} / ({seconds} / 60.0::DOUBLE) END",
    "td_rate": "{td} / {n}::DOUBLE", "td_accuracy": "CASE WHEN {tried} > 0 THEN {td} / {tried}::DOUBLE END", "td_defense": "CASE WHEN {opp_tried} > 0 THEN 1 - {opp_td} / {opp_tried}::DOUBLE END",
    "strike_defense": "CASE WHEN {opp_attempted} > 0 THEN 1 - {opp_landed} / {opp_attempted}::DOUBLE END", "ctrl_time_per_fight": "{control} / {n}::DOUBLE", "sub_att_per_fight": "{subs} / {n}::DOUBLE",
}
_COUNTED = ["seconds", "landed", "total", "td", "tried", "opp_td", "opp_tried", "opp_attempted", "opp_landed", "control", "subs"]
_EWMA = "coalesce(list_reduce(list({c}) FILTER ({c} IS NOT NULL) OVER " + BEFORE + ", lambda a, x: a * (1 - 0.206) + x * 0.206), 0)"


def _performance_sql() -> str:
    sums = ", ".join(f"coalesce(sum({c}) OVER w, 0) AS {c}" for c in _COUNTED)
    one = ", ".join(v.format(**{c: c for c in _COUNTED}, n=1) + f" AS one_{k}" for k, v in _RATES.items())
    zero = lambda k, v: f"coalesce({v}, 0)" if k.endswith("minute") else v
    mean = ", ".join(f"CASE WHEN n > 0 THEN {zero(k, v.format(**{c: c for c in _COUNTED}, n='n'))} END AS {k}" for k, v in _RATES.items())
    rolled = ", ".join(
        f"CASE WHEN len(list({c}) FILTER ({c} IS NOT NULL) OVER {BEFORE}) >= {n} THEN list_sum((list({c}) FILTER ({c} IS NOT NULL) OVER {BEFORE})[-{n}:]) / {n}::DOUBLE END AS {k}_last{n}"
        for n in (3, 5) for k, c in assembly.ROLLED.items()
    )
    return BOUTS + STATS + f""", own AS (SELECT fight_id, event_date, fighter, opponent, seconds, landed, attempted, landed + 3 * td_attempted AS total, td_landed AS td, td_attempted AS tried, control, td_attempted - td_landed AS subs FROM stats),
met AS (SELECT a.*, b.landed AS opp_landed, b.attempted AS opp_attempted, b.td AS opp_td, b.tried AS opp_tried FROM own a LEFT JOIN own b ON a.fight_id = b.fight_id AND a.opponent = b.fighter),
one AS (SELECT fight_id, event_date, fighter, {one} FROM met),
e AS (SELECT fight_id, fighter, {', '.join(_EWMA.format(c=f'one_{k}') + f' AS {k}_ewma' for k in _RATES)} FROM one),
totals AS (SELECT fight_id, event_date, fighter, count(*) OVER w AS n, {sums} FROM met WINDOW w AS {BEFORE}),
means AS (SELECT fight_id, event_date, fighter, n, {mean} FROM totals),
rolled AS (SELECT fight_id, fighter, {rolled} FROM means)
SELECT fight_id, fighter, {', '.join(f'm.{k}' for k in _RATES)}, {', '.join(f'CASE WHEN m.n > 0 THEN e.{k}_ewma END AS {k}_ewma' for k in _RATES)}, r.* EXCLUDE (fight_id, fighter)
FROM means m JOIN e USING (fight_id, fighter) JOIN rolled r USING (fight_id, fighter)"""


#: the trend of the rounds, unrounded
_PACED = SQL["pace_decay_before"].replace("round(", "(").replace(", 9) AS", ") AS")
_DOMAIN = "CASE WHEN fight_id % 23 <> 0 THEN CAST(1300 + (fight_id * {0} + fighter * {1}) % 400 AS DOUBLE) END"
_RATINGS = {"elo_overall": "CAST(1300 + (fight_id * 31 + fighter * 17) % 400 AS DOUBLE)", "elo_striking": _DOMAIN.format(29, 19), "elo_grappling": _DOMAIN.format(37, 11)}


def _velocity_sql(expression: str) -> str:
    return BOUTS + f""", rated AS (SELECT fight_id, event_date, fighter, coalesce({expression}, 1500) AS rating FROM sides),
l AS (SELECT fight_id, fighter, coalesce(list(r ORDER BY d, f), []) AS l FROM (SELECT a.fight_id, a.fighter, b.rating AS r, b.event_date AS d, b.fight_id AS f
FROM rated a LEFT JOIN rated b ON a.fighter = b.fighter AND b.event_date < a.event_date) GROUP BY ALL)
SELECT fight_id, fighter, CASE WHEN len(l) >= 6 THEN (l[-1] - l[-6]) / 5 END AS velocity FROM l"""


def _matrix_sql(feature_set: str) -> str:
    wide = feature_set == "v2.5-travel"
    out = {f"{k}_diff": f"coalesce(a.{k}, 1500) - coalesce(b.{k}, 1500)" for k in matrix.RATINGS}
    plain = [*_RATES, *(f"{k}_ewma" for k in _RATES), *matrix.PHYSICAL, *matrix.CAREER, *matrix.PACE, *matrix.LAYOFF, *matrix.ROLLING, "pre_ufc_win_pct"]
    out |= {f"{k}_diff": f"a.{k} - b.{k}" for k in plain}
    for k, c in (("opp_adj_sig_str", "sig_str_per_minute"), ("opp_adj_td", "td_rate"), ("opp_adj_strike_def", "strike_defense"), ("opp_adj_ctrl_time", "ctrl_time_per_fight")):
        own = lambda s, c=c: f"CASE WHEN {s}.sig_str_per_minute IS NOT NULL THEN coalesce({s}.{c}, 0) END" if c == "strike_defense" else f"{s}.{c}"
        adjusted = lambda s, o, c=c: f"coalesce({own(s)} / nullif({o}.{c}, 0), {own(s)})"
        out[f"{k}_diff"] = f"{adjusted('a', 'b')} - {adjusted('b', 'a')}"
    out |= {
        "stance_matchup": "CAST(coalesce(nullif(a.stance, 'Switch'), 'Orthodox') = coalesce(nullif(b.stance, 'Switch'), 'Orthodox') AS DOUBLE)",
        "a_striking_vs_b_grappling": "coalesce(a.elo_striking, 1500) - coalesce(b.elo_grappling, 1500)", "a_grappling_vs_b_striking": "coalesce(a.elo_grappling, 1500) - coalesce(b.elo_striking, 1500)",
        "is_title_fight": "CAST(o.fight_id % 10 = 3 AS DOUBLE)", "num_rounds": "CASE WHEN o.fight_id % 4 = 0 THEN 5.0 ELSE 3.0 END", "weight_class_ordinal": "5.0",
        "is_rematch": "CAST(r.rematch AS DOUBLE)", "first_fight_winner_diff": "CASE WHEN r.rematch = 1 AND r.first_winner = o.a THEN 1.0 WHEN r.rematch = 1 AND r.first_winner = o.b THEN -1.0 ELSE 0.0 END",
        "opening_prob_diff": "a.opening - b.opening", "closing_prob_diff": "a.closing - b.closing", "line_movement_diff": "(a.closing - a.opening) - (b.closing - b.opening)",
        "sharp_money_signal": "abs((a.closing - a.opening) - (b.closing - b.opening))", "odds_elo_divergence": "a.closing - 1 / (1 + pow(10.0::DOUBLE, (coalesce(b.elo_overall, 1500) - coalesce(a.elo_overall, 1500)) / 400))",
    }
    more = joins = ""
    if wide:
        for s, name in (("a", "red"), ("b", "blue")):
            out |= {f"travel_distance_miles_{name}": f"{s}.miles", f"tz_shift_{name}_signed": f"{s}.tz_shift", f"layoff_days_{name}": f"{s}.layoff_days", f"age_at_fight_{name}": f"{s}.age"}
        out |= {"travel_distance_miles_diff": "a.miles - b.miles", "tz_shift_diff_signed": "a.tz_shift - b.tz_shift", "travel_distance_diff_km": "a.km - b.km", "tz_shift_diff_hours": "a.tz_shift_clipped - b.tz_shift_clipped"}
        out |= {f"ref_{k}_rate_shrunk": f"f.{k}_rate" for k in ("finish", "decision", "no_action")}
        out |= {f"{k}_velocity_diff": f"a.{k}_velocity - b.{k}_velocity" for k in matrix.RATINGS}
        out |= {"division_finish_rate_shrunk": "(d.bouts_before * (d.finish_rate - 0.5) + 50 * (d.finish_rate - 0.5) + 0.5 * d.bouts_before + 50 * g.g) / (d.bouts_before + 50)", "reach_diff_normalized": "(a.raw_reach - b.raw_reach) / nullif(h.mean_reach, 0)"}
        more = ", " + ", ".join(f"{k}_v AS ({_velocity_sql(v)})" for k, v in _RATINGS.items()) + f""", travel AS ({SQL['travel_features']}), rest AS ({SQL[reports.layoff_clipped.__name__]}), judged AS ({SQL['referee_rates_asof']}),
finishes AS ({SQL['division_rate_asof']}), overall AS (SELECT count(*) FILTER (method IN ('KO/TKO', 'Submission')) / count(*)::DOUBLE AS g FROM bouts), reaches AS ({SQL['mean_reach_distinct']})"""
        joins = " LEFT JOIN judged f ON o.fight_id = f.fight_id JOIN finishes d ON o.fight_id = d.fight_id CROSS JOIN overall g LEFT JOIN reaches h ON o.division = h.division"
    snap = SQL["career_snapshot"]
    states = ["win_streak", "loss_streak", "win_pct", "bouts", "days_since_last", "ko_win_rate", "sub_win_rate", "ko_loss_rate", "sub_loss_rate", "cage_minutes", "avg_seconds", "division_bouts", "is_debut", "bouts_per_year", "avg_opponent_rating", "momentum"]
    named = ", ".join(f"s.{c} AS {k}" for k, c in zip(matrix.CAREER, states))
    paces = ", ".join(f"c.{p} AS {k}" for k, p in zip(matrix.PACE, ["pace_strikes", "pace_td", "pace_variance", "pace_first_round"]))
    wider = ", " + ", ".join(f"{k}_v.velocity AS {k}_velocity" for k in _RATINGS) + ", travel.miles, travel.km, travel.tz_shift, travel.tz_shift_clipped, rest.layoff_days" if wide else ""
    met = "".join(f" LEFT JOIN {t} USING (fight_id, fighter)" for t in (*(f"{k}_v" for k in _RATINGS), "travel", "rest")) if wide else ""
    return BOUTS.replace("WITH sums", "WITH perf AS (" + _performance_sql() + f"), snap AS ({snap}), paced AS ({_PACED}), medians AS ({SQL['division_medians']}), early AS ({SQL['early_career_records']}), fair AS ({SQL['fair_probabilities']}), again AS ({SQL['rematch_flags']}), sums", 1) + PHYSICALS + more + f""",
own AS (SELECT fight_id, fighter, {', '.join(f'{v} AS {k}' for k, v in _RATINGS.items())}, perf.* EXCLUDE (fight_id, fighter), {named}, {paces},
  ln(1 + s.days_since_last) AS log_days_since_last_fight, coalesce(CAST(s.days_since_last < 60 AS DOUBLE), 0) AS is_short_turnaround, coalesce(CAST(s.days_since_last > 365 AS DOUBLE), 0) AS is_comeback,
  coalesce(p.height, m.height) AS height, coalesce(p.reach, m.reach) AS reach, coalesce(p.height - 40, m.leg) AS leg_reach, p.reach AS raw_reach, (x.event_date - p.born) / 365.25::DOUBLE AS age, p.stance, e.win_pct AS pre_ufc_win_pct,
  CASE WHEN x.fighter < x.opponent THEN fair.open_a ELSE fair.open_b END AS opening, CASE WHEN x.fighter < x.opponent THEN fair.close_a ELSE fair.close_b END AS closing{wider}
  FROM sides x JOIN perf USING (fight_id, fighter) JOIN snap s USING (fight_id, fighter) JOIN paced c USING (fight_id, fighter) JOIN fair USING (fight_id){met}
  LEFT JOIN physicals p ON x.fighter = p.fighter LEFT JOIN early e ON x.fighter = e.fighter LEFT JOIN medians m ON x.division = m.division),
o AS (SELECT fight_id, event_date, division, winner, CASE WHEN kept THEN fighter_a ELSE fighter_b END AS a, CASE WHEN kept THEN fighter_b ELSE fighter_a END AS b
  FROM (SELECT *, right(md5(CAST(fight_id AS VARCHAR)), 1) IN ('0','2','4','6','8','a','c','e') AS kept FROM bouts))
SELECT o.fight_id, o.event_date, CAST(o.winner = o.a AS INT) AS y, {', '.join(f'round(CAST({out[c]} AS DOUBLE), 6) AS {c}' for c in matrix.feature_columns(feature_set))}
FROM o JOIN own a ON o.fight_id = a.fight_id AND o.a = a.fighter JOIN own b ON o.fight_id = b.fight_id AND o.b = b.fighter JOIN again r ON o.fight_id = r.fight_id{joins}"""


def _rated(spark, sf_dir) -> DataFrame:
    """Sides with three ratings made up from the ids; the domains' are missing for some bouts."""
    k = lambda x, y: (1300 + (F.col("fight_id") * x + F.col("fighter") * y) % 400).cast("double")
    known = F.col("fight_id") % 23 != 0
    return sides(spark, sf_dir).withColumns({"elo_overall": k(31, 17), "elo_striking": F.when(known, k(29, 19)), "elo_grappling": F.when(known, k(37, 11))})


def blocks(spark, sf_dir, feature_set: str) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The bouts with their context, and the blocks of a feature set by side and by bout."""
    rated = _rated(spark, sf_dir)
    b = bouts(spark, sf_dir)
    other = rated.select("fight_id", F.col("fighter").alias("opponent"), F.col("elo_overall").alias("opponent_rating"))
    stats = base.stats(spark, sf_dir).withColumns({"total_landed": F.col("landed") + 3 * F.col("td_attempted"), "sub_attempts": F.col("td_attempted") - F.col("td_landed")})
    body = base.physicals(spark, sf_dir).withColumn("leg", F.col("height") - 40)
    market = profiles.market(spark, sf_dir)
    both = F.explode(F.array(*(F.struct(F.col(f"fighter_{s}").alias("fighter"), F.col(f"open_{s}").alias("opening"), F.col(f"close_{s}").alias("closing")) for s in "ab")))
    prices = market.select("fight_id", both.alias("p")).select("fight_id", "p.fighter", "p.opening", "p.closing", F.lit(True).alias("priced"))
    by_side = [
        rated.select("fight_id", "fighter", *matrix.RATINGS), assembly.performance(stats),
        assembly.states(rated.join(other, ["fight_id", "opponent"]).withColumn("seconds", base.seconds(F.col("fight_id")))),
        assembly.pace(base.rounds(spark, sf_dir), rated), prices,
        assembly.bodies(rated, body, profiles.division_medians(spark, sf_dir), profiles.early_career_records(spark, sf_dir)),
    ]
    by_bout = [queries.rematch_flags(spark, sf_dir).select("fight_id", "rematch", "first_winner")]
    context = b.withColumns({"is_title": (F.col("fight_id") % 10 == 3).cast("int"), "rounds": F.when(F.col("fight_id") % 4 == 0, 5).otherwise(3)})
    if feature_set == "v1.0":
        late = rated.select(F.col("event_date").alias("as_of"), F.col("fighter").alias("node"))
        net = graph.network_features(rated.select("fight_id", "event_date", "fighter"), graph.pagerank_asof(graph.edges(b), late, graph.DECAY))
        by_side.append(net.select("fight_id", "fighter", *(F.col(c).alias(k) for k, c in zip(matrix.NETWORK, ("rank", "sos", "in_graph_debut")))))
    if feature_set in ("v2.2", "v2.5-travel"):
        by_side += [
            profiles.travel_features(spark, sf_dir).select("fight_id", "fighter", "miles", "km", "tz_shift", "tz_shift_clipped"), assembly.layoffs(rated),
            *(career.velocity(rated.withColumn(k, F.coalesce(k, F.lit(assembly.INITIAL))), rating=k).withColumnRenamed("velocity", f"{k}_velocity") for k in matrix.RATINGS),
        ]
        overall = b.agg((F.count_if(F.col("method").isin("KO/TKO", "Submission")) / F.count("*")).alias("g"))
        days = career.rates_by_day(b, ["division"], {"finish": F.col("method").isin("KO/TKO", "Submission")}).join(F.broadcast(overall))
        finishes = b.select("fight_id", "division", "event_date").join(days, ["division", "event_date"]).join(profiles.mean_reach_distinct(spark, sf_dir), "division", "left")
        by_bout += [
            career_queries.referee_rates_asof(spark, sf_dir).select("fight_id", "finish_rate", "decision_rate", "no_action_rate"),
            finishes.select("fight_id", history.shrunk(F.col("finish"), F.col("n"), F.col("g")).alias("division_finish_rate"), "mean_reach"),
        ]
    return context, by_side, by_bout


def feature_matrix(spark, sf_dir, feature_set: str) -> DataFrame:
    """Each block is written once, so that the shuffles of one are gone when the next is made."""
    with materialised(spark, sf_dir):
        context, by_side, by_bout = blocks(spark, sf_dir, feature_set)
        out = assembly.columns(assembly.together(graph.stored(context), [*map(graph.stored, by_side)], [*map(graph.stored, by_bout)]), feature_set)
    return out.select("fight_id", "event_date", "y", *(F.round(c, 6).alias(c) for c in matrix.feature_columns(feature_set)))


@query(_matrix_sql("v2.1-no-net"))
def feature_matrix_72(spark, sf_dir) -> DataFrame:
    """Every bout's 72 columns in the order of the contract: ratings, performance, measurements, career, pace, layoff, rolling, market."""
    return feature_matrix(spark, sf_dir, "v2.1-no-net")


@query(_matrix_sql("v2.5-travel"))
def feature_matrix_92(spark, sf_dir) -> DataFrame:
    """The 72 columns, then referee, travel, layoff, age, velocity, division and reach columns, and travel in kilometres and hours."""
    return feature_matrix(spark, sf_dir, "v2.5-travel")


