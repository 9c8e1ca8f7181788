"""Queries of learners, fuzzy names, pages and streams: their results have invariants rather than SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.operators import evaluation, graph, models, names, neighbours, resampling, seeds
from boutlens.plans import evaluations
from boutlens.plans.base import BOUTS, physicals
from boutlens.plans.bouts import sides, table
from boutlens.plans.registry import query
from boutlens.sources import pages
from boutlens.streaming import records


@query()
def pca_embeddings(spark, sf_dir) -> DataFrame:
    """Eight principal components of each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    return models.embeddings(e, [f"x{i}" for i in range(64)]).select("vec_id", "embedding")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id)
SELECT id, CAST(row_number() OVER w AS INT) AS rank, other, round(s, 6) AS similarity FROM p WINDOW w AS (PARTITION BY id ORDER BY s DESC, other) QUALIFY row_number() OVER w <= 10""")
def nearest_ten(spark, sf_dir) -> DataFrame:
    """The ten most similar others of every vector."""
    out = neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("id", "rank", "other", F.round("similarity", 6).alias("similarity"))


def _level_one(spark, sf_dir) -> DataFrame:
    """Three scores of each decided bout, made up from the ids, one of them with a little of the outcome."""
    s = evaluations.scored(spark, sf_dir)
    return s.select("fight_id", "event_date", "y", F.col("p").alias("xgb"), ((F.col("fight_id") * 31) % 1000 / 1000.0 + 0.1 * F.col("y")).alias("elo"), (F.col("gap") / 400.0 - 0.5).alias("close"))


@query()
def stacker_oof(spark, sf_dir) -> DataFrame:
    """Held-out probabilities of a stacker of three scores and their products, five folds in the order of time."""
    rows = graph.stored(_level_one(spark, sf_dir))
    stack = models.stacker(["xgb", "elo", "close"], rows=rows.count())
    return models.out_of_fold(rows, 5, ["event_date", "fight_id"], stack.fit).select("fight_id", "fold", "y", "p")


@query()
def boosted_oof(spark, sf_dir) -> DataFrame:
    """Held-out probabilities of boosted trees, three folds in the order of time, calibrated on the first."""
    rows = models.assembled(_level_one(spark, sf_dir), ["xgb", "elo", "close"])
    out = models.out_of_fold(rows, 3, ["event_date", "fight_id"], models.boosted(maxDepth=2, maxIter=5).fit)
    return models.calibrated(out.filter("fold > 1"), out.filter("fold = 1")).select("fight_id", "fold", "y", "p")


@query()
def seed_noise_floor(spark, sf_dir) -> DataFrame:
    """Medians and spread over ten seeds of trees grown on bouts before 2001 and scored on later ones, by year."""
    rows = _level_one(spark, sf_dir).withColumn("year", F.year("event_date"))
    chosen = list(range(10))
    forest = seeds.fit(rows.filter("year < 2001"), ["xgb", "elo", "close"], chosen, params=seeds.Params(trees=4, depth=2))
    return seeds.noise_floor(seeds.probabilities(rows.filter("year >= 2001"), forest), "year", chosen)


@query()
def bootstrap_ci(spark, sf_dir) -> DataFrame:
    """Half the width of the 68 % interval of each slice's Brier score."""
    s = evaluations.sliced(spark, sf_dir).withColumn("error", F.pow(F.col("p") - F.col("y"), 2))
    return models.bootstrap_intervals(s, "slice", "error")


@query()
def bootstrap_accuracy_ci(spark, sf_dir) -> DataFrame:
    """Half the width of the 68 % interval of each slice's accuracy."""
    s = evaluations.sliced(spark, sf_dir).withColumn("right", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double"))
    return models.bootstrap_intervals(s, "slice", "right")


@query()
def bin_intervals(spark, sf_dir) -> DataFrame:
    """The observed rate of each bin of scores in each slice, with its 95 % percentile interval."""
    return resampling.bin_intervals(evaluations.sliced(spark, sf_dir), ["slice"])


@query()
def resampled_metrics(spark, sf_dir) -> DataFrame:
    """Brier scores of ten bootstrap copies of each slice, and whether they differ."""
    rows = models.resampled(evaluations.sliced(spark, sf_dir), 10, "fight_id")
    metrics = rows.groupBy("slice", "seed").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    return evaluation.seed_medians(metrics)


def _mistyped(name):
    """One letter dropped."""
    return F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100))


@query()
def fuzzy_match_names(spark, sf_dir) -> DataFrame:
    """Mistyped names of a day's fighters found again among that day's names."""
    s = graph.stored(sides(spark, sf_dir).select(F.col("event_date").alias("day"), "fighter", "fight_id").join(physicals(spark, sf_dir).select("fighter", "name"), "fighter"))
    left = s.select("day", (F.col("fight_id") * 1000 + F.col("fighter")).alias("left_id"), _mistyped(F.col("name")).alias("left_name"))
    return names.best_match(left, s.select("day", F.col("fighter").alias("right_id"), F.col("name").alias("right_name")), ["day"], 80.0)


@query()
def match_places(spark, sf_dir) -> DataFrame:
    """Locations found among venues: equal after normalising, else by sorted tokens."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("right_id"), F.concat(F.lit("Arena of "), "n_name", F.lit(", Old Town")).alias("right_name"))
    left = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("left_id"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("ARENA of  "), "n_name", F.lit(", Old Town"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("Old Town, Arena of "), "n_name")).otherwise("Nowhere").alias("left_name"),
    )
    return names.exact_then_fuzzy(left, n)


@query()
def alias_tiers(spark, sf_dir) -> DataFrame:
    """Names of another source told apart on a day's card by tiers of rules."""
    first = F.element_at(F.array(*(F.lit(x) for x in ("Anna", "Bo", "Cy", "Dee", "Eve"))), (F.col("fighter") % 5 + 1).cast("int"))
    last = F.concat(F.lit("N"), (F.col("fighter") % 37).cast("string"))
    s = graph.stored(sides(spark, sf_dir).select("fight_id", F.col("event_date").alias("day"), "fighter", first.alias("f"), last.alias("l")))
    card = s.select("day", "fighter", F.concat_ws(" ", "f", "l").alias("fighter_name"))
    k = F.col("fight_id") % 6
    other = F.when(k == 0, F.concat_ws(" ", "f", "l")).when(k == 1, F.concat(F.substring("f", 1, 1), F.lit(". "), F.col("l"))).when(k == 2, F.concat_ws(" ", F.lit("Zed"), "l")).when(k == 3, F.concat_ws(" ", F.lit("The"), F.lit("Hammer"))).when(k == 4, F.concat_ws(" ", "l", "f")).otherwise("Nobody Known")
    registry = spark.createDataFrame([("The Hammer", "Anna N0", 3), ("the hammer", "Bo N1", 5)], "alias string, canonical string, tier int")
    asked = s.select((F.col("fight_id") * 1000 + F.col("fighter")).alias("id"), other.alias("name"), "day")
    return names.alias_tiers(asked, card, registry)


@query()
def html_extract(spark, sf_dir) -> DataFrame:
    """Title, description, links, tables and words of raw pages."""
    return pages.page_facts(table(spark, sf_dir, "pages"))


@query("""SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_daily_counts(spark, sf_dir) -> DataFrame:
    """The events as a stream of files, counted by day: all rows once the stream has ended."""
    static = table(spark, sf_dir, "events")
    stream = records.read_files(spark, f"{sf_dir}/events.parquet*", static.schema)
    name = "boutlens_daily_counts"
    running = records.counts_by_window(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query(BOUTS + """SELECT fighter, count(*) AS bouts, count(*) FILTER (won = 1) AS wins, count(*) FILTER (won = 0) AS losses, round(avg(won), 9) AS rate FROM sides GROUP BY ALL""")
def running_totals(spark, sf_dir) -> DataFrame:
    """What the running record ends with, as a batch."""
    return sides(spark, sf_dir).groupBy("fighter").agg(F.count("*").alias("bouts"), F.count_if(F.col("won") == 1).alias("wins"), F.count_if(F.col("won") == 0).alias("losses"), F.round(F.avg("won"), 9).alias("rate"))
