"""Queries that judge predictions; scores, seeds and coefficients are made up from the ids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.functions import odds as fn
from boutlens.operators import evaluation, matching
from boutlens.plans.base import BOUTS, PHYSICALS, physicals
from boutlens.plans.bouts import bouts, sides, table
from boutlens.plans.registry import query

SCORED = """, scored AS (SELECT fight_id, event_date, division, fighter_a, fighter_b, ((fight_id * 7919) % 1000) / 1000.0::DOUBLE AS p, CAST(winner = fighter_a AS INT) AS y,
((fight_id * 104729) % 1000) / 1000.0::DOUBLE AS draw, CAST((fight_id * 31) % 400 AS DOUBLE) AS gap FROM bouts WHERE winner IS NOT NULL)
"""
_SLICED = SCORED + """, sliced AS (SELECT s.*, slice FROM scored s, unnest([CASE WHEN event_date >= DATE '2001-08-01' - 365 THEN 'most_recent_12mo' END, CASE WHEN event_date >= DATE '2001-08-01' - 730 THEN 'most_recent_24mo' END,
CASE WHEN draw < 0.15 THEN 'random_15pct' END]) AS u(slice) WHERE slice IS NOT NULL)
"""


def scored(spark, sf_dir) -> DataFrame:
    k = F.col("fight_id")
    return bouts(spark, sf_dir).filter("winner is not null").select(
        "fight_id", "event_date", "division", "fighter_a", "fighter_b", ((k * 7919) % 1000 / 1000.0).alias("p"), (F.col("winner") == F.col("fighter_a")).cast("int").alias("y"),
        ((k * 104729) % 1000 / 1000.0).alias("draw"), ((k * 31) % 400).cast("double").alias("gap"),
    )


def sliced(spark, sf_dir) -> DataFrame:
    return evaluation.in_slices(scored(spark, sf_dir), F.lit("2001-08-01").cast("date"))


@query(BOUTS + _SLICED + "SELECT slice, count(*) AS n, round(avg(pow(p - y, 2)), 9) AS brier, avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)) AS accuracy FROM sliced GROUP BY ALL")
def metrics_by_date_slice(spark, sf_dir) -> DataFrame:
    """Brier score and accuracy of the last 12 and 24 months and of a hashed 15 %."""
    return evaluation.brier_accuracy(sliced(spark, sf_dir), "slice").select("slice", "n", F.round("brier", 9).alias("brier"), "accuracy")


@query(BOUTS + SCORED + """, b AS (SELECT CASE WHEN gap < 50 THEN '0-50' WHEN gap < 100 THEN '50-100' WHEN gap < 200 THEN '100-200' WHEN gap < 300 THEN '200-300' ELSE '300+' END AS bucket, count(*) AS count, avg(p) AS p, avg(y) AS o FROM scored GROUP BY ALL)
SELECT bucket, count, round(p, 9) AS predicted, round(o, 9) AS observed, round(abs(p - o), 9) AS gap, abs(p - o) <= 0.05 AS within FROM b""")
def elo_gap_buckets(spark, sf_dir) -> DataFrame:
    out = evaluation.gap_buckets(scored(spark, sf_dir), "gap")
    return out.select("bucket", "count", *(F.round(c, 9).alias(c) for c in ("predicted", "observed", "gap")), "within")


_SEEDS = _SLICED + """, seeded AS (SELECT slice, seed, avg(pow(((fight_id * (7919 + seed * 2)) % 1000) / 1000.0::DOUBLE - y, 2)) AS brier, avg(CAST(CAST(((fight_id * (7919 + seed * 2)) % 1000) >= 500 AS INT) = y AS INT)) AS accuracy
FROM sliced, unnest([0, 1, 2, 3, 4]) AS u(seed) GROUP BY ALL),
med AS (SELECT slice, count(*) AS seeds, median(brier) AS mb, median(accuracy) AS ma, coalesce(stddev_samp(brier), 0) AS sb, coalesce(stddev_samp(accuracy), 0) AS sa, count(DISTINCT brier) = count(DISTINCT seed) AS d FROM seeded GROUP BY ALL)
"""


def _seed_metrics(spark, sf_dir) -> DataFrame:
    rows = sliced(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = rows.withColumn("p", (F.col("fight_id") * (7919 + F.col("seed") * 2)) % 1000 / 1000.0)
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    return rows.groupBy("slice", "seed").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(right).alias("accuracy"))


@query(BOUTS + _SEEDS + """SELECT slice, seeds, round(mb, 9) AS median_brier, round(ma, 9) AS median_accuracy, round(sb, 9) AS std_brier, round(sa, 9) AS std_accuracy, d AS seeds_differ,
round_even(mb - sb, 4) AS brier_max, round_even(ma + sa, 4) AS formula_accuracy, greatest(round_even(ma + sa, 4), 0.5) AS accuracy_min, round_even(ma + sa, 4) < 0.5 AS breach FROM med""")
def seed_variance_gate(spark, sf_dir) -> DataFrame:
    """Medians and deviations over five seeds, and the limits that they set."""
    out = evaluation.thresholds(evaluation.seed_medians(_seed_metrics(spark, sf_dir)), 0.5)
    return out.select("slice", "seeds", *(F.round(c, 9).alias(c) for c in ("median_brier", "median_accuracy", "std_brier", "std_accuracy")), "seeds_differ", "brier_max", "formula_accuracy", "accuracy_min", "breach")


@query(BOUTS + _SEEDS + """, f AS (SELECT slice || ': brier_score' AS w FROM med WHERE mb > CASE WHEN slice = 'random_15pct' THEN 0.2 ELSE 0.9 END UNION ALL SELECT slice || ': accuracy' FROM med WHERE ma < 0.4)
SELECT count(*) = 0 AS passed, coalesce(string_agg(w, '; ' ORDER BY w), '') AS failed FROM f""")
def promotion_gate(spark, sf_dir) -> DataFrame:
    medians = evaluation.seed_medians(_seed_metrics(spark, sf_dir))
    limits = medians.select("slice", F.when(F.col("slice") == "random_15pct", 0.2).otherwise(0.9).alias("brier_max"), F.lit(0.4).alias("accuracy_min"))
    return evaluation.gate(medians, limits)


_TESTS = """WITH c AS (SELECT c_custkey AS candidate_id, t, i, 0.20 + ((c_custkey * 7 + i) % 20) / 1000.0::DOUBLE AS baseline, 0.20 + ((c_custkey * 11 + i * 3 + t) % 20) / 1000.0::DOUBLE + CASE WHEN c_custkey % 9 = 4 THEN 0.1 ELSE 0 END AS refit,
0.195 + ((c_custkey * 13 + i * 5 + t * 2) % 20) / 1000.0::DOUBLE AS candidate, 0.212 AS brier_max, CASE WHEN c_custkey % 17 = 3 AND t = 2 THEN 15 ELSE 13 END AS width FROM customer, unnest([1, 2]) AS a(t), unnest([0, 1, 2]) AS b(i)),
v AS (SELECT candidate_id, t, max(abs((baseline - candidate) - (refit - candidate))) AS drift, bool_and(candidate <= brier_max) AS floors, sum(refit - candidate) AS margin, bool_or(width <> 13) AS wide FROM c GROUP BY ALL),
w AS (SELECT *, CASE WHEN wide OR drift > 0.05 THEN 'confound_block' WHEN floors AND margin >= 0.003 THEN 'path_a_promote' ELSE 'path_b_reject' END AS verdict FROM v)
"""


@query(_TESTS + """SELECT a.candidate_id, a.verdict AS first, b.verdict AS second, CASE WHEN a.verdict = 'confound_block' AND a.wide OR b.verdict = 'confound_block' AND b.wide THEN 'width_mismatch_dual' WHEN a.verdict = 'confound_block' OR b.verdict = 'confound_block' THEN 'confound_block_dual'
WHEN a.verdict = 'path_a_promote' AND b.verdict = 'path_a_promote' THEN 'path_a_promote_dual' WHEN a.verdict = 'path_a_promote' THEN 'substrate_drift_artifact' WHEN b.verdict = 'path_a_promote' THEN 'highly_suspect' ELSE 'path_b_reject_dual' END AS verdict
FROM w a JOIN w b ON a.candidate_id = b.candidate_id AND a.t = 1 AND b.t = 2""")
def gate_verdict_dual(spark, sf_dir) -> DataFrame:
    """Verdicts of candidates on two data sets, and the two put together."""
    k = F.col("candidate_id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"))
    c = c.withColumn("t", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    t, i = F.col("t"), F.col("i")
    rows = c.withColumns({
        "baseline": 0.20 + ((k * 7 + i) % 20) / 1000.0, "refit": 0.20 + ((k * 11 + i * 3 + t) % 20) / 1000.0 + F.when(k % 9 == 4, 0.1).otherwise(0.0),
        "candidate": 0.195 + ((k * 13 + i * 5 + t * 2) % 20) / 1000.0, "brier_max": F.lit(0.212), "width": F.when((k % 17 == 3) & (t == 2), 15).otherwise(13), "expected_width": F.lit(13),
    })
    one, two = (evaluation.verdicts(rows.filter(t == n), "candidate_id").select("candidate_id", F.col("verdict").alias(v), F.col("width_mismatch").alias(w)) for n, v, w in ((1, "first", "w1"), (2, "second", "w2")))
    return one.join(two, "candidate_id").select("candidate_id", "first", "second", evaluation.dual_verdict("first", "second", "w1", "w2").alias("verdict"))


@query("""WITH c AS (SELECT p_partkey % 40 AS feature, p_partkey AS seed, ((p_partkey * 7919) % 201 - 100) / 100.0::DOUBLE AS value FROM part), m AS (SELECT feature, median(value) AS m FROM c GROUP BY ALL)
SELECT feature, round(stddev_pop(value), 9) AS std, avg(CAST(sign(value) = sign(m) AS INT)) AS sign_agreement, abs(any_value(m)) AS median_abs FROM c JOIN m USING (feature) GROUP BY ALL""")
def coefficient_stability(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select((k % 40).alias("feature"), (((k * 7919) % 201 - 100) / 100.0).alias("value"))
    out = evaluation.coefficient_stability(c)
    return out.select("feature", F.round("std", 9).alias("std"), "sign_agreement", "median_abs")


@query("""WITH r AS (SELECT o_orderkey % 3 AS s, o_orderkey AS k FROM orders), x AS (SELECT 's' || s AS slice, CASE WHEN k % 997 = 0 THEN 2 ELSE k % 2 END AS outcome, CASE WHEN s = 1 AND k % 500 = 1 THEN 14 ELSE 13 END AS width,
CASE WHEN k % 1500 = 0 THEN NULL WHEN s = 2 AND k % 700 = 2 THEN 'sha0' ELSE 'sha' || s END AS sha FROM r)
SELECT 'outcome' AS rule, count(*) FILTER (outcome NOT IN (0, 1)) AS n FROM x UNION ALL SELECT 'null', count(*) FILTER (sha IS NULL) FROM x
UNION ALL SELECT 'width', count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT width) AS n FROM x GROUP BY slice) UNION ALL SELECT 'slice_shas', count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT sha) AS n FROM x GROUP BY slice)
UNION ALL SELECT 'sha_slices', count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT slice) AS n FROM x GROUP BY sha)""")
def substrate_checks(spark, sf_dir) -> DataFrame:
    """Faults of an evaluation table, counted rule by rule."""
    k, s = F.col("o_orderkey"), F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), s.cast("string")).alias("slice"), F.when(k % 997 == 0, 2).otherwise(k % 2).alias("outcome"),
        F.array_repeat(F.lit(0.5), F.when((s == 1) & (k % 500 == 1), 14).otherwise(13)).alias("vector"),
        F.when(k % 1500 == 0, None).when((s == 2) & (k % 700 == 2), "sha0").otherwise(F.concat(F.lit("sha"), s.cast("string"))).alias("sha"),
    )
    return evaluation.snapshot_checks(rows)


def _hex_sum(i: int) -> str:
    return f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS HUGEINT)) AS VARCHAR)"


@query(BOUTS + f""", h AS (SELECT division, sha256(concat_ws('|', CAST(fight_id AS VARCHAR), CAST(event_date AS VARCHAR), coalesce(CAST(winner AS VARCHAR), ''))) AS h FROM bouts)
SELECT division, count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {', '.join(_hex_sum(i) for i in range(8))})) AS digest FROM h GROUP BY ALL""")
def content_digest(spark, sf_dir) -> DataFrame:
    """A digest of each division's bouts that no order of rows changes."""
    return evaluation.content_digest(bouts(spark, sf_dir), "division", ["fight_id", "event_date", "winner"])


@query(BOUTS + PHYSICALS + """, x AS (SELECT s.fight_id, s.fighter, s.event_date, p.height, p.reach, CASE WHEN p.stance IS NOT NULL THEN 1.0::DOUBLE END AS base FROM sides s JOIN physicals p USING (fighter) WHERE p.stance IS NOT NULL),
m AS (SELECT median(height) AS h, median(reach) AS r FROM x WHERE event_date < DATE '1999-01-01') SELECT fight_id, fighter, coalesce(height, h) AS height, coalesce(reach, r) AS reach FROM x, m WHERE event_date >= DATE '1999-01-01'""")
def median_imputation(spark, sf_dir) -> DataFrame:
    """Rows without a baseline value go; other missing values of later rows get the median of the earlier ones."""
    rows = sides(spark, sf_dir).join(physicals(spark, sf_dir), "fighter").select("fight_id", "fighter", "event_date", "height", "reach", "stance")
    cut = F.lit("1999-01-01").cast("date")
    _, test = evaluation.impute_median(rows.filter(F.col("event_date") < cut), rows.filter(F.col("event_date") >= cut), ["height", "reach"], ["stance"])
    return test.select("fight_id", "fighter", "height", "reach")


@query(BOUTS + """, n AS (SELECT fight_id, event_date, row_number() OVER (ORDER BY event_date, fight_id) - 1 AS position, count(*) OVER () AS n FROM bouts)
SELECT fight_id, position, CAST(greatest(0, floor((position - (n - 5 * (n // 6))) / (n // 6)::DOUBLE) + 1) AS INT) AS fold FROM n""")
def time_series_folds(spark, sf_dir) -> DataFrame:
    """Five test folds of equal size in the order of time; fold 0 is only learnt from."""
    return evaluation.folds(bouts(spark, sf_dir), 5, ["event_date", "fight_id"]).select("fight_id", "position", "fold")


@query(BOUTS + """SELECT fight_id, CASE WHEN event_date < DATE '1999-01-01' AND event_date >= DATE '1995-06-01' THEN 'train' WHEN event_date >= DATE '2000-06-01' THEN 'test' WHEN event_date >= DATE '1999-01-01' THEN 'calibration' END AS part FROM bouts""")
def three_way_split(spark, sf_dir) -> DataFrame:
    """Disjoint parts by day; bouts before the lower bound belong to none."""
    day = F.col("event_date")
    at = lambda s: F.lit(s).cast("date")
    part = F.when((day < at("1999-01-01")) & (day >= at("1995-06-01")), "train").when(day >= at("2000-06-01"), "test").when(day >= at("1999-01-01"), "calibration")
    return bouts(spark, sf_dir).select("fight_id", part.alias("part"))


def grid() -> list[tuple[str, dict]]:
    """The parameter sweeps of the rating: (name, what differs from the defaults)."""
    out = [("k", {"k_first": float(a), "k_later": float(b), "k_bouts": c}) for a, b, c in product(range(20, 65, 5), range(10, 35, 5), range(3, 8))]
    out += [("margin", {"ko": a / 10, "submission": b / 10, "split": c / 10}) for a, b, c in product(range(12, 19), range(11, 18), range(5, 11))]
    out += [("transfer", {"transfer": x / 100}) for x in (50, 60, 70, 75, 80, 90, 100)]
    for name, values in (("idle_days", (270, 365, 456, 548)), ("idle_rate", (0.05, 0.08, 0.1, 0.15, 0.2)), ("idle_most", (0.3, 0.4, 0.5, 0.6, 0.75))):
        out += [("inactivity", {name: x}) for x in values]
    return out


@query("""SELECT 'k' AS sweep, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y, CAST(c AS DOUBLE) AS z FROM range(20, 65, 5) t(a), range(10, 35, 5) u(b), range(3, 8) v(c)
UNION ALL SELECT 'margin', a / 10.0::DOUBLE, b / 10.0::DOUBLE, c / 10.0::DOUBLE FROM range(12, 19) t(a), range(11, 18) u(b), range(5, 11) v(c)
UNION ALL SELECT 'transfer', x / 100.0::DOUBLE, NULL, NULL FROM unnest([50, 60, 70, 75, 80, 90, 100]) t(x)
UNION ALL SELECT 'inactivity', x, NULL, NULL FROM unnest([270, 365, 456, 548, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75]::DOUBLE[]) t(x)
UNION ALL SELECT 'half_life', x, NULL, NULL FROM unnest([2, 3, 4, 5]::DOUBLE[]) t(x)
UNION ALL SELECT 'attribution', a / 100.0::DOUBLE, b / 100.0::DOUBLE, NULL FROM range(60, 110, 10) t(a), range(0, 50, 10) u(b)""")
def param_grid(spark, sf_dir) -> DataFrame:
    """All sweeps of the rating's parameters, built by crossing sequences."""
    seq = lambda lo, hi, step, name: spark.range(lo, hi, step).select(F.col("id").cast("double").alias(name))
    three = lambda n, a, b, c, by: seq(*a, "x").crossJoin(seq(*b, "y")).crossJoin(seq(*c, "z")).select(F.lit(n).alias("sweep"), *((F.col(k) / by).alias(k) for k in "xyz"))
    one = lambda n, values: spark.createDataFrame([(n, float(v), None, None) for v in values], "sweep string, x double, y double, z double")
    out = three("k", (20, 65, 5), (10, 35, 5), (3, 8, 1), 1.0).union(three("margin", (12, 19, 1), (11, 18, 1), (5, 11, 1), 10.0))
    out = out.union(one("transfer", [d["transfer"] for n, d in grid() if n == "transfer"])).union(one("inactivity", [v for n, d in grid() if n == "inactivity" for v in d.values()]))
    shares = seq(60, 110, 10, "x").crossJoin(seq(0, 50, 10, "y")).select(F.lit("attribution").alias("sweep"), (F.col("x") / 100.0).alias("x"), (F.col("y") / 100.0).alias("y"), F.lit(None).cast("double").alias("z"))
    return out.union(one("half_life", [2, 3, 4, 5])).union(shares)


@query("""SELECT c_mktsegment AS stratum, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) AS n FROM customer) WHERE n <= 12""")
def stratified_sample(spark, sf_dir) -> DataFrame:
    """Twelve customers of each segment, by a hash of id and seed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("id"))
    return matching.sample_by_hash(c, "id", 12, 42, "stratum")


@query("""WITH s AS (SELECT c_nationkey AS stratum, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) // 7 AS k FROM s),
q AS (SELECT stratum, k, (n * k) // total AS base, (n * k) % total AS rest FROM s, t), a AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= k - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM q)
SELECT c_nationkey AS stratum, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':42'), c_custkey) AS p FROM customer) JOIN a ON c_nationkey = stratum WHERE p <= take""")
def proportional_sample(spark, sf_dir) -> DataFrame:
    """A seventh of the customers, each nation by its share, whole by the largest remainder."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stratum"), F.col("c_custkey").alias("id"))
    return matching.proportional_sample(c, "id", c.count() // 7, 42, "stratum")


@query("SELECT c_custkey AS id FROM customer ORDER BY md5(c_custkey || ':7'), c_custkey LIMIT 25")
def seeded_sample(spark, sf_dir) -> DataFrame:
    return matching.sample_by_hash(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", 25, 7)


@query(BOUTS + SCORED + """SELECT fight_id, 0.5 * (p + (1 - draw)) AS symmetric, CASE WHEN draw < 0.3 THEN 'fallback' WHEN p >= 0.5 THEN 'meta' ELSE 'base' END AS route, CASE WHEN fight_id >= 1000 THEN 'isotonic' ELSE 'sigmoid' END AS calibration,
CASE WHEN abs(p - draw) < 0.01 THEN 'identical' WHEN abs(p - draw) < 0.1 THEN 'close' ELSE 'divergent' END AS divergence FROM scored""")
def prediction_routing(spark, sf_dir) -> DataFrame:
    """Which model answers (no closing price: the fallback), the order-free probability, the calibration by sample size."""
    p, d = F.col("p"), F.col("draw")
    gap = F.abs(p - d)
    return scored(spark, sf_dir).select(
        "fight_id", fn.symmetric(p, d).alias("symmetric"), F.when(d < 0.3, "fallback").when(p >= 0.5, "meta").otherwise("base").alias("route"), fn.calibration_method(F.col("fight_id")).alias("calibration"),
        F.when(gap < 0.01, "identical").when(gap < 0.1, "close").otherwise("divergent").alias("divergence"),
    )


@query("""SELECT 'bouts' AS relation, count(*) AS rows FROM orders UNION ALL SELECT 'fighters', count(*) FROM supplier UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'venues', count(*) FROM nation""")
def table_counts(spark, sf_dir) -> DataFrame:
    names = {"bouts": "orders", "fighters": "supplier", "lines": "lineitem", "events": "events", "venues": "nation"}
    out = None
    for name, t in names.items():
        one = table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(BOUTS + """, a AS (SELECT division, count(*) AS before FROM bouts WHERE event_date < DATE '2000-01-01' GROUP BY ALL), b AS (SELECT division, count(*) AS after FROM bouts GROUP BY ALL)
SELECT division, coalesce(before, 0) AS before, after, after - coalesce(before, 0) AS delta, round(100 * (after - coalesce(before, 0)) / after::DOUBLE, 2) AS pct FROM b LEFT JOIN a USING (division)""")
def snapshot_delta(spark, sf_dir) -> DataFrame:
    """Counts before and after a date, and their difference."""
    b = bouts(spark, sf_dir).groupBy("division").agg(F.count_if(F.col("event_date") < F.lit("2000-01-01").cast("date")).alias("before"), F.count("*").alias("after"))
    delta = F.col("after") - F.col("before")
    return b.withColumns({"delta": delta, "pct": F.round(100 * delta / F.col("after"), 2)})


@query("""SELECT c_custkey AS candidate, CASE WHEN count(*) FILTER (abs(remeasured) < 0.05 AND reported > 0.2) >= 2 THEN 'artifact' WHEN bool_and(clears) AND count(*) FILTER (remeasured >= 0.003) >= 2 THEN 'real' ELSE 'real_but_floor_misses' END AS verdict
FROM (SELECT c_custkey, ((c_custkey * 7 + i * 31) % 100) / 1000.0::DOUBLE - 0.02 AS remeasured, ((c_custkey * 5 + i) % 10) / 20.0::DOUBLE AS reported, (c_custkey + i) % 7 <> 0 AS clears FROM customer, unnest([0, 1, 2]) t(i)) GROUP BY ALL""")
def divergence_verdicts(spark, sf_dir) -> DataFrame:
    """Whether each candidate's reported gain is real after remeasuring on three slices."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate")).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k, i = F.col("candidate"), F.col("i")
    slices = c.select("candidate", ((k * 7 + i * 31) % 100 / 1000.0 - 0.02).alias("remeasured"), ((k * 5 + i) % 10 / 20.0).alias("reported"), ((k + i) % 7 != 0).alias("clears"))
    return evaluation.divergence(slices)


@query(BOUTS + _SLICED + """, full_ AS (SELECT unnest(['most_recent_12mo', 'most_recent_24mo', 'random_15pct', 'women']) AS slice, (SELECT count(*) // 8 FROM scored) AS expected), own AS (SELECT slice, count(*) AS n FROM sliced GROUP BY ALL)
SELECT slice, coalesce(n, 0) AS rows, expected, coalesce(n, 0) / expected::DOUBLE AS share, coalesce(n, 0) > 0 AND coalesce(n, 0) / expected::DOUBLE >= 0.5 AS passes FROM full_ LEFT JOIN own USING (slice)""")
def slice_coverage(spark, sf_dir) -> DataFrame:
    """Rows of each slice against an eighth of the decided bouts; a slice without rows appears and fails."""
    names = spark.createDataFrame([(s,) for s in ("most_recent_12mo", "most_recent_24mo", "random_15pct", "women")], "slice string")
    full = names.crossJoin(scored(spark, sf_dir).agg(F.floor(F.count("*") / 8).alias("expected")))
    return evaluation.slice_coverage(sliced(spark, sf_dir), full)


_NAMES = ["Strawweight", "Flyweight", "Bantamweight", "Featherweight", "Lightweight", "Welterweight", "Middleweight", "Light Heavyweight", "Heavyweight", "Women's Strawweight", "Women's Flyweight", "Women's Bantamweight", "Women's Featherweight", "Catch Weight"]


@query("""SELECT c_custkey AS id, CASE c_custkey % 15 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 8 WHEN 8 THEN 9 WHEN 9 THEN 1 WHEN 10 THEN 2 WHEN 11 THEN 3 WHEN 12 THEN 4 ELSE 5 END::DOUBLE AS ordinal FROM customer""")
def division_ordinals(spark, sf_dir) -> DataFrame:
    """Every division's place in the order of weights, 5 for unknown ones and null."""
    named = F.get(F.array(*(F.lit(n) for n in _NAMES)), (F.col("c_custkey") % 15).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.division_ordinal(named).alias("ordinal"))
