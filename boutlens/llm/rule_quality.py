"""Quality classifier: a sparse ensemble of rules compiled to Spark columns.

Statistics of a text are DataFrame expressions. On a bounded sample of labelled rows (about ``MOST_ROWS``,
drawn by a hash of the id) shallow trees are grown on random halves of rows and features; every path of a
tree is a conjunctive rule; a logistic model with an L1 penalty weighs the rules, and those with weight are
compiled to one Spark expression, so that every row is scored inside the JVM.

Null and empty texts have all-zero statistics and are scored like others, whole texts are measured however long.
Without labelled rows the score is 0.5 everywhere; with one class only, or too few rows for a rule, it is the smoothed share of the labels. Ties between
splits go to the feature and cut tried first. An empty table gives no rows; extra columns are ignored whatever their
names; repeated rows are scored alike; a null doc_id is no label's, its row is scored and counts neither as held out nor
as learnt from (null).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import learnable

MOST_ROWS = 20_000
TREES, DEPTH, CUTS, LEAST_LEAF = 60, 3, 24, 5
PENALTY, ROUNDS = 0.002, 1500


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of whole texts; each is 0 for an empty text."""
    n = F.char_length(text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    low = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def without(pattern):
        return n - F.char_length(F.regexp_replace(text, pattern, ""))

    def share(part, whole):
        return part / F.greatest(whole, F.lit(1))

    letters = without(r"\p{L}+")
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(words.cast("double")),
        "word_chars": share(n, words),
        "letters": share(letters, n),
        "upper": share(without(r"\p{Lu}+"), letters),
        "digits": share(without(r"\p{N}+"), n),
        "spaces": share(without(r"\s+"), n),
        "commas_stops": share(without("[.,]+"), words),
        "shouts": share(without("[!?]+"), words),
        "symbols": share(without(r"[^\p{L}\p{N}\s.,!?;:'\"()-]+"), words),
        "bars": share(without(r"[|<>{}\[\]\\/_=]+"), words),
        "line_words": share(words, F.size(lines)),
        "new_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "new_words": share(F.size(F.array_distinct(low)), F.size(low)),
        "stops": share(without(r"[.!?](?=\s|$)"), words),
    }


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Rules of one tree: tuples of (feature, whether above, cut)."""
    features = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
    rules = []

    def split(rows, path, depth):
        if path:
            rules.append(path)
        own = y[rows]
        if depth == 0 or len(rows) < 2 * LEAST_LEAF or own.min() == own.max():
            return
        best = None
        for f in features:
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])):
                above = v > cut
                n = int(above.sum())
                if min(n, len(rows) - n) < LEAST_LEAF:
                    continue
                p, q = own[above].mean(), own[~above].mean()
                impurity = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(cut), above)
        if best is not None:
            _, f, cut, above = best
            split(rows[above], (*path, (f, True, cut)), depth - 1)
            split(rows[~above], (*path, (f, False, cut)), depth - 1)

    split(rng.permutation(len(x))[: max(2 * LEAST_LEAF, len(x) // 2)], (), DEPTH)
    return rules


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in rule])


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    a = np.column_stack([np.ones(len(r)), r])
    step = 4 * len(a) / np.linalg.norm(a, 2) ** 2
    w = ahead = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(ROUNDS):
        grad = a.T @ (1 / (1 + np.exp(-a @ ahead)) - y) / len(a)
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / u * (new - w), new, u
    return float(w[0]), w[1:]


def learn(x: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, weighted rules)."""
    if not len(y):
        return 0.0, []
    p = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(rule for _ in range(TREES) for rule in grow(x, y, rng))) if y.min() < y.max() else []
    if not rules:
        return float(np.log(p / (1 - p))), []
    held = np.column_stack([_holds(x, rule) for rule in rules]).astype(float)
    _, first = np.unique(held, axis=1, return_index=True)
    first = np.sort(first)
    base, weights = lasso_logistic(held[:, first], y)
    return base, [(rules[i], float(w)) for i, w in zip(first, weights) if abs(w) > 1e-6]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int = MOST_ROWS) -> tuple[float, list]:
    """Rules learnt from ``labels.quality`` of the rows that may be learnt from."""
    marked = labels.filter(may_learn & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    n = marked.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    some = marked.filter(draw < min(1.0, most / n)) if n else marked
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stats = statistics(F.col("text"))
    rows = texts.join(some, "doc_id").select("doc_id", "quality", *(c.cast("double").alias(k) for k, c in stats.items()))
    got = rows.toPandas().sort_values(["doc_id", "quality"])
    return learn(got[list(stats)].to_numpy(), got["quality"].to_numpy())


def score(docs: DataFrame, model: tuple[float, list]) -> DataFrame:
    """(doc_id, score) of every row."""
    base, rules = model
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *(c.cast("double").alias(k) for k, c in stats.items()))

    def column(rule):
        return reduce(lambda a, b: a & b, ((F.col(names[f]) > cut) if above else (F.col(names[f]) <= cut) for f, above, cut in rule))

    total = reduce(lambda a, b: a + b, (F.when(column(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in rules), F.lit(base))
    return rows.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def op8_rule_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, learnable()))
    return out.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
