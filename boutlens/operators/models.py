"""Learners on feature frames: embeddings, boosted trees with a search over time-ordered folds, stacking, resampling.

All fits run as Spark jobs of pyspark.ml; folds and parameter sets are loops over jobs, rows never come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.operators import evaluation, resampling
from boutlens.operators.graph import stored

#: what is tried for boosted trees
SEARCH = [{"maxDepth": d, "stepSize": s, "maxIter": n} for d, s, n in ((2, 0.1, 20), (3, 0.1, 20), (3, 0.3, 10))]
#: at this accuracy or more held-out predictions are taken for leaked
LEAKY = 0.75


def embeddings(features: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """``features`` with ``embedding``: the first ``k`` principal components of the standardised columns, nulls 0.

    Columns are scaled by the population deviation; a component's sign is arbitrary.
    """
    n = features.count()
    filled = features.fillna(0.0, columns)
    shrink = float(np.sqrt(n / max(n - 1, 1)))
    stages = [VectorAssembler(inputCols=columns, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True), PCA(k=min(k, len(columns)), inputCol="__s", outputCol="__p")]
    out = Pipeline(stages=stages).fit(filled).transform(filled)
    return out.withColumn("embedding", F.transform(vector_to_array("__p"), lambda x: x * shrink)).drop("__v", "__s", "__p")


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the vector ``features``; missing values are 0 beside a flag for each column that has any."""
    flags = [F.col(c).isNull().cast("double").alias(f"__no_{c}") for c in columns]
    filled = df.select("*", *flags).fillna(0.0, columns)
    return VectorAssembler(inputCols=[*columns, *(f"__no_{c}" for c in columns)], outputCol="features").transform(filled).drop(*(f"__no_{c}" for c in columns))


def probability(model, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def boosted(seed: int = 42, **params) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="y", seed=seed, **params)


def brier(df: DataFrame, p: str = "p", y: str = "y") -> float:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2))).first()[0]


def out_of_fold(df: DataFrame, k: int, order: list[str], fit: Callable[[DataFrame], object], guard: bool = True) -> DataFrame:
    """``df``'s rows of the test folds with ``p`` of a model of all rows before their fold.

    An accuracy of ``LEAKY`` or more raises: no honest model of these outcomes reaches it. The rows are derived and
    numbered once, for all fits.
    """
    marked = stored(evaluation.folds(stored(df), k, order))
    out = None
    for i in range(1, k + 1):
        one = probability(fit(marked.filter(F.col("fold") < i)), marked.filter(F.col("fold") == i))
        out = one if out is None else out.unionByName(one)
    if guard:
        accuracy = out.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
        if accuracy is not None and accuracy >= LEAKY:
            raise ValueError(f"an accuracy of {accuracy:.3f} on held-out rows: the features know the outcome")
    return out


def search(df: DataFrame, k: int, order: list[str], tries: list[dict] = SEARCH, seed: int = 42) -> tuple[dict, float]:
    """(parameters, Brier score) of the boosted trees that do best on held-out folds."""
    scores = [(brier(out_of_fold(df, k, order, boosted(seed, **t).fit, guard=False)), i) for i, t in enumerate(tries)]
    best, i = min(scores)
    return tries[i], best


def calibrated(df: DataFrame, held: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with ``p`` calibrated on the rows ``held``: isotonic from a thousand of them on, else a logistic curve of the log odds."""
    n = held.count()
    if n >= 1000:
        model = IsotonicRegression(featuresCol=p, labelCol="y", predictionCol="__c").fit(held.withColumn("y", F.col("y").cast("double")))
        return model.transform(df).withColumn(p, F.col("__c")).drop("__c")
    logit = F.log(F.greatest(F.col(p), F.lit(1e-6)) / F.greatest(1 - F.col(p), F.lit(1e-6)))
    with_logit = lambda d: VectorAssembler(inputCols=["__l"], outputCol="__x").transform(d.withColumn("__l", logit))
    model = LogisticRegression(featuresCol="__x", labelCol="y", regParam=0.0).fit(with_logit(held))
    out = model.transform(with_logit(df))
    return out.withColumn(p, vector_to_array("probability")[1]).drop("__l", "__x", "rawPrediction", "probability", "prediction")


def ensemble(train: DataFrame, test: DataFrame, seed: int = 42) -> DataFrame:
    """``test`` with ``p``: the mean of boosted trees, a forest, a logistic model and a deeper boosted model."""
    learners = [boosted(seed, maxDepth=3, maxIter=10), RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=20, seed=seed), LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01), boosted(seed + 1, maxDepth=5, maxIter=10)]
    out = test
    for i, learner in enumerate(learners):
        out = probability(learner.fit(train), out, f"__p{i}")
    return out.withColumn("p", sum(F.col(f"__p{i}") for i in range(len(learners))) / len(learners)).drop(*(f"__p{i}" for i in range(len(learners))))


def stacker(columns: list[str], c: float = 1.0, rows: int = 1) -> Pipeline:
    """Columns and their pairwise products, standardised, into a logistic model with an L2 penalty of 1 / (c rows)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    from pyspark.ml.feature import SQLTransformer

    products = ", ".join(f"`{a}` * `{b}` AS `__{i}`" for i, (a, b) in enumerate(pairs))
    names = [*columns, *(f"__{i}" for i in range(len(pairs)))]
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *{', ' + products if products else ''} FROM __THIS__"), VectorAssembler(inputCols=names, outputCol="__v"),
        StandardScaler(inputCol="__v", outputCol="features", withMean=True, withStd=True), LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0),
    ])


def bootstrap_intervals(df: DataFrame, by: str, value: str, level: float = 0.68, resamples: int = resampling.RESAMPLES, seed: int = 42) -> DataFrame:
    """(by, n, mean, half): half the width of the BCa interval of each slice's mean; null for equal values."""
    out = resampling.intervals(df, [by], value, level, resamples, seed)
    return out.select(by, "n", "mean", ((F.col("high") - F.col("low")) / 2).alias("half"))


def resampled(df: DataFrame, seeds: int, key: str) -> DataFrame:
    """``seeds`` bootstrap copies of the rows: each row as often as a Poisson draw of its key and the seed says."""
    draw = F.pmod(F.xxhash64(F.col(key), F.col("seed")), F.lit(1 << 30)) / float(1 << 30)
    cuts = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(8)]).tolist()
    times = sum((draw > c).cast("int") for c in cuts)
    marked = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("__n", times)
    return marked.filter("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
