"""Searches over parameters in stages: each sweep alone, then the cross product of the best of each.

Configurations are evaluated together: a rating is a vector with an entry for each, and a history carries a weighted
mean for each half-life, so that a stage is one pass whatever it tries. Only the best few of each sweep come to the
driver.
"""

from __future__ import annotations

import datetime
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlens.functions.odds import RATING
from boutlens.operators import assembly, history, models, rating
from boutlens.operators.graph import checkpointed

TOP = 3


def best_of_sweeps(bouts: DataFrame, sweeps: dict[str, list[dict]], split: datetime.date, top: int = TOP, held: tuple[DataFrame, int] | None = None) -> dict[str, list[dict]]:
    """The ``top`` changes of each sweep by Brier score, ties to the one that comes first; ``held`` as in rating.backtest()."""
    tried = [(name, change) for name, changes in sweeps.items() for change in changes]
    names = bouts.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(tried)], "config long, sweep string")
    scored = rating.backtest(bouts, [RATING | change for _, change in tried], split, held).join(names, "config")
    place = F.row_number().over(Window.partitionBy("sweep").orderBy("brier", "config"))
    rows = scored.withColumn("place", place).filter(F.col("place") <= top).select("sweep", "config", "place").collect()
    return {name: [tried[r["config"]][1] for r in sorted(rows, key=lambda r: r["place"]) if r["sweep"] == name] for name in sweeps}


def joint(bouts: DataFrame, sweeps: dict[str, list[dict]], split: datetime.date, top: int = TOP) -> DataFrame:
    """(place, changed, n, brier, accuracy) of the cross product of the ``top`` changes of each sweep, the best first."""
    held = rating.held_for_backtests(bouts)
    best = best_of_sweeps(bouts, sweeps, split, top, held)
    combined = [dict(x for change in changes for x in change.items()) for changes in product(*best.values())]
    names = bouts.sparkSession.createDataFrame([(i, str(sorted(c.items()))) for i, c in enumerate(combined)], "config long, changed string")
    out = rating.backtest(bouts, [RATING | c for c in combined], split, held).join(names, "config")
    place = F.row_number().over(Window.orderBy("brier", "config"))  # a row for each of top ** len(sweeps) configurations
    return out.select(place.alias("place"), "changed", "n", "brier", "accuracy")


def half_lives(stats: DataFrame, bouts: DataFrame, lives: list[float], split: datetime.date) -> DataFrame:
    """(half_life, alpha, n, brier): how well differences of weighted means foretell decided bouts from ``split`` on.

    All half-lives are folded in one pass over the histories; a logistic model of each is fit on the bouts before.
    Bouts of a fighter without an earlier one take no part.
    """
    alphas = {h: 1 - 0.5 ** (1 / h) for h in lives}
    one = assembly.single_rates(stats).withColumn("seen", F.lit(1.0))
    means = {f"{c}_{i}": (f"one_{c}", a) for i, a in enumerate(alphas.values()) for c in assembly.RATES}
    known = history.folded(one, means | {"any": ("seen", 0.5)}, {}).filter("any > 0")
    decided = bouts.filter("winner is not null").select("fight_id", "event_date", "fighter_a", "fighter_b", (F.col("winner") == F.col("fighter_a")).cast("double").alias("y"))
    side = lambda s: known.select("fight_id", F.col("fighter").alias(f"fighter_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in means))
    met = decided.join(side("a"), ["fight_id", "fighter_a"]).join(side("b"), ["fight_id", "fighter_b"])
    rows = checkpointed(met.select("event_date", "y", *((F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in means)))
    out = None
    for i, (life, alpha) in enumerate(alphas.items()):
        own = VectorAssembler(inputCols=[f"{c}_{i}" for c in assembly.RATES], outputCol="features").transform(rows)
        train, test = own.filter(F.col("event_date") < F.lit(split)), own.filter(F.col("event_date") >= F.lit(split))
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / max(train.count(), 1), standardization=False, maxIter=200).fit(train)
        scored = models.probability(model, test).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
        row = scored.select(F.lit(float(life)).alias("half_life"), F.lit(alpha).alias("alpha"), "n", "brier")
        out = row if out is None else out.unionByName(row)
    return out
