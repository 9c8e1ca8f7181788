"""Evaluation of probabilistic predictions, by slice, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brier_accuracy(df: DataFrame, by: str, p: str = "p", y: str = "y") -> DataFrame:
    right = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(right).alias("accuracy"))


def auc(df: DataFrame, by: str, p: str = "p", y: str = "y") -> DataFrame:
    """Rank-sum AUC with average ranks. Rows fold to one per slice and score before they are ordered."""
    scores = df.groupBy(by, p).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    below = F.sum("n").over(Window.partitionBy(by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    ranked = scores.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(by).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("pos")
    return sums.select(by, ((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / F.when((F.col("pos") > 0) & (neg > 0), F.col("pos") * neg)).alias("auc"))


def calibration(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Uniform left-closed bins; empty bins don't appear."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return df.groupBy(at).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    curve = calibration(df, bins)
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def in_slices(df: DataFrame, anchor, day: str = "event_date", draw: str = "draw") -> DataFrame:
    """A row for each slice that a row belongs to: the last 12 and 24 months before ``anchor``, and a random 15 %.

    ``draw`` is a number in [0, 1) that depends on the row's key alone, so that the slice doesn't depend on any order.
    """
    names = F.array_compact(F.array(
        F.when(F.col(day) >= F.date_sub(anchor, 365), "most_recent_12mo"), F.when(F.col(day) >= F.date_sub(anchor, 730), "most_recent_24mo"), F.when(F.col(draw) < 0.15, "random_15pct"),
    ))
    return df.withColumn("slice", F.explode(names))


def gap_buckets(df: DataFrame, gap: str, p: str = "p", y: str = "y", threshold: float = 0.05) -> DataFrame:
    """Predicted and observed rates by the size of the rating gap; empty buckets don't appear."""
    g = F.abs(gap)
    name = F.when(g < 50, "0-50").when(g < 100, "50-100").when(g < 200, "100-200").when(g < 300, "200-300").otherwise("300+")
    by = df.groupBy(name.alias("bucket")).agg(F.count("*").alias("count"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))
    miss = F.abs(F.col("predicted") - F.col("observed"))
    return by.withColumns({"gap": miss, "within": miss <= threshold})


def seed_medians(metrics: DataFrame, by: str = "slice") -> DataFrame:
    """Over seeds: medians, sample deviations (0 for one seed), and whether every seed has its own Brier score."""
    return metrics.groupBy(by).agg(
        F.count("*").alias("seeds"), F.median("brier").alias("median_brier"), F.median("accuracy").alias("median_accuracy"),
        F.coalesce(F.stddev_samp("brier"), F.lit(0.0)).alias("std_brier"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std_accuracy"),
        (F.countDistinct("brier") == F.countDistinct("seed")).alias("seeds_differ"),
    )


def thresholds(medians: DataFrame, floor: float) -> DataFrame:
    """What a candidate has to reach: the median moved by one deviation, four digits, halves to even; accuracy has a floor."""
    brier, accuracy = F.bround(F.col("median_brier") - F.col("std_brier"), 4), F.bround(F.col("median_accuracy") + F.col("std_accuracy"), 4)
    return medians.withColumns({"brier_max": brier, "formula_accuracy": accuracy, "accuracy_min": F.greatest(accuracy, F.lit(floor)), "breach": accuracy < floor})


def gate(metrics: DataFrame, limits: DataFrame, by: str = "slice") -> DataFrame:
    """One row: whether all slices pass, and what fails."""
    met = metrics.join(limits.select(by, "brier_max", "accuracy_min"), by)
    fails = F.array_compact(F.array(
        F.when(F.col("median_brier") > F.col("brier_max"), F.concat(by, F.lit(": brier_score"))), F.when(F.col("median_accuracy") < F.col("accuracy_min"), F.concat(by, F.lit(": accuracy"))),
    ))
    return met.agg(F.array_sort(F.flatten(F.collect_list(fails))).alias("failed")).select((F.size("failed") == 0).alias("passed"), F.array_join("failed", "; ").alias("failed"))


def verdicts(slices: DataFrame, by: str, confound: float = 0.05, hurdle: float = 0.003) -> DataFrame:
    """The verdict on each candidate from its slices: raw and refitted baseline, candidate, limit, widths of both vectors.

    Different widths block, a baseline that drifted by more than ``confound`` blocks; else every slice has to keep its
    limit and the gains over the refitted baseline have to reach ``hurdle`` together.
    """
    d = slices.withColumns({"raw": F.col("baseline") - F.col("candidate"), "aligned": F.col("refit") - F.col("candidate")})
    agg = d.groupBy(by).agg(
        F.max(F.abs(F.col("raw") - F.col("aligned"))).alias("drift"), F.bool_and(F.col("candidate") <= F.col("brier_max")).alias("floors"), F.sum("aligned").alias("margin"),
        F.bool_or(F.col("width") != F.col("expected_width")).alias("width_mismatch"),
    )
    verdict = F.when(F.col("width_mismatch") | (F.col("drift") > confound), "confound_block").when(F.col("floors") & (F.col("margin") >= hurdle), "path_a_promote").otherwise("path_b_reject")
    return agg.withColumn("verdict", verdict)


def dual_verdict(first: str, second: str, first_width: str, second_width: str):
    """Two tests of one candidate, on its own and on the baseline's data, put together; the first rule that holds."""
    a, b = F.col(first), F.col(second)
    block = "confound_block"
    return (
        F.when(((a == block) & F.col(first_width)) | ((b == block) & F.col(second_width)), "width_mismatch_dual").when((a == block) | (b == block), "confound_block_dual")
        .when((a == "path_a_promote") & (b == "path_a_promote"), "path_a_promote_dual").when(a == "path_a_promote", "substrate_drift_artifact")
        .when(b == "path_a_promote", "highly_suspect").otherwise("path_b_reject_dual")
    )


def coefficient_stability(coefficients: DataFrame, by: str = "feature") -> DataFrame:
    """Over seeds: population deviation, share of signs that agree with the median's, size of the median."""
    middle = coefficients.groupBy(by).agg(F.median("value").alias("m"))
    met = coefficients.join(middle, by)
    return met.groupBy(by).agg(F.stddev_pop("value").alias("std"), F.avg((F.signum("value") == F.signum("m")).cast("double")).alias("sign_agreement"), F.abs(F.first("m")).alias("median_abs"))


def snapshot_checks(rows: DataFrame) -> DataFrame:
    """Faults of an evaluation table (slice, vector, outcome, sha), one row each with their number.

    Outcomes outside {0, 1}, nulls, slices of several widths, slices of several digests, digests of several slices.
    """
    by = rows.groupBy("slice").agg(F.countDistinct(F.size("vector")).alias("widths"), F.countDistinct("sha").alias("shas"))
    shared = rows.groupBy("sha").agg(F.countDistinct("slice").alias("slices"))
    parts = [
        rows.agg(F.count_if(~F.coalesce(F.col("outcome").isin(0, 1), F.lit(False))).alias("n")).select(F.lit("outcome").alias("rule"), "n"),
        rows.agg(F.count_if(F.col("vector").isNull() | F.col("slice").isNull() | F.col("sha").isNull()).alias("n")).select(F.lit("null").alias("rule"), "n"),
        by.agg(F.count_if(F.col("widths") > 1).alias("n")).select(F.lit("width").alias("rule"), "n"),
        by.agg(F.count_if(F.col("shas") > 1).alias("n")).select(F.lit("slice_shas").alias("rule"), "n"),
        shared.agg(F.count_if(F.col("slices") > 1).alias("n")).select(F.lit("sha_slices").alias("rule"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def content_digest(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order.

    Rows are digested one by one and folded by sums, so that a group is never gathered: the digest of a multiset.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = lambda i: F.conv(F.substring("__row", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = rows.withColumn("__row", row).groupBy(by).agg(F.count("*").alias("rows"), *(F.sum(part(i)).alias(f"s{i}") for i in range(8)))
    return sums.select(by, "rows", F.sha2(F.concat_ws("|", "rows", *(F.col(f"s{i}").cast("decimal(38,0)").cast("string") for i in range(8))), 256).alias("digest"))


def impute_median(train: DataFrame, test: DataFrame, columns: list[str], strict: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a null in a ``strict`` column go; nulls of ``columns`` become the median of the training rows that stay."""
    train, test = train.dropna(subset=strict), test.dropna(subset=strict)
    middle = train.agg(*(F.median(c).alias(f"__{c}") for c in columns))

    def filled(df):
        met = df.join(F.broadcast(middle))
        return met.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns))

    return filled(train), filled(test)


def folds(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """``df`` with ``fold``: rows in order, the last k * (n // (k + 1)) of them in k test folds of equal size, earlier ones 0.

    A fold is tested on a model of all rows before it.
    """
    n = df.count()
    size = n // (k + 1)
    ranked = with_position(df, order)
    return ranked.withColumn("fold", F.greatest(F.lit(0), F.floor((F.col("position") - (n - k * size)) / F.lit(max(size, 1))) + 1).cast("int"))


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place from 0 in the order of unique keys.

    Rows are numbered inside the ranges of the first key and offset by the sizes of the ranges before: no task sorts
    all rows.
    """
    first = order[0]
    sizes = df.groupBy(first).agg(F.count("*").alias("__n"))
    before = sizes.select(F.col(first).alias("__key"), (F.sum("__n").over(Window.orderBy(first)) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(first).orderBy(*order[1:])) - 1
    met = df.withColumn("__inside", inside).join(before, F.col(first).eqNullSafe(F.col("__key")))
    return met.withColumn(name, F.col("__before") + F.col("__inside")).drop("__inside", "__key", "__before")


def nan_drop(df: DataFrame, columns: list[str], policy: str = "symmetric", baseline: tuple[str, ...] = ("xgb_oof_prob", "elo_prob")) -> DataFrame:
    """Rows fit to learn from: without a null in any column, or ("per_feature_strict_baseline") in the baseline's alone."""
    if policy == "symmetric":
        return df.dropna(subset=columns)
    if policy != "per_feature_strict_baseline":
        raise ValueError(f"unknown policy {policy!r}")
    missing = [c for c in baseline if c not in columns]
    if missing:
        raise KeyError(f"baseline columns that aren't there: {missing}")
    return df.dropna(subset=list(baseline))


def composition(slices: DataFrame, steps: DataFrame, by: str = "candidate", hurdle: float = 0.003) -> DataFrame:
    """The decision on each composed candidate: slices (by, brier, baseline, accuracy, brier_max, accuracy_min), steps (by, clears).

    All three have to hold: every slice within its limits, every slice better than the baseline by the hurdle, every
    step cleared. Path b: some steps cleared and not all, and either a limit was missed or the steps alone failed.
    """
    bad = F.col("brier").isNull() | F.isnan("brier")
    s = slices.groupBy(by).agg(
        F.bool_and(~bad & (F.col("brier") <= F.col("brier_max")) & (F.col("accuracy") >= F.col("accuracy_min"))).alias("gate"),
        F.bool_and(~bad & (F.col("baseline") - F.col("brier") >= hurdle)).alias("margin"), F.bool_or(bad).alias("unknown"),
    )
    t = steps.groupBy(by).agg(F.bool_and("clears").alias("all_steps"), F.bool_or("clears").alias("any_step"))
    met = s.join(t, by)
    partial = F.col("any_step") & ~F.col("all_steps") & (~F.col("gate") | F.col("margin"))
    path = F.when(F.col("gate") & F.col("margin") & F.col("all_steps"), "path_a").when(~F.col("unknown") & partial, "path_b").otherwise("path_c")
    return met.select(by, "gate", "margin", "all_steps", path.alias("path"), F.when(path == "path_a", "promote").otherwise("reject").alias("verdict"))


def divergence(slices: DataFrame, by: str = "candidate", hurdle: float = 0.003) -> DataFrame:
    """Whether a gain is real: slices (by, remeasured, reported, clears). Two slices whose reported gain above 0.2 shrank below
    0.05 make it an artifact."""
    s = slices.groupBy(by).agg(
        F.count_if((F.abs("remeasured") < 0.05) & (F.col("reported") > 0.2)).alias("shrunk"), F.bool_and("clears").alias("clears"), F.count_if(F.col("remeasured") >= hurdle).alias("gains")
    )
    return s.select(by, F.when(F.col("shrunk") >= 2, "artifact").when(F.col("clears") & (F.col("gains") >= 2), "real").otherwise("real_but_floor_misses").alias("verdict"))


def slice_coverage(slices: DataFrame, full: DataFrame, by: str = "slice", least: float = 0.5) -> DataFrame:
    """Rows of each slice against the rows it should have; empty slices appear and fail."""
    own = slices.groupBy(by).agg(F.count("*").alias("rows"))
    met = full.join(own, by, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    share = F.col("rows") / F.col("expected")
    return met.select(by, "rows", "expected", share.alias("share"), ((F.col("rows") > 0) & (share >= least)).alias("passes"))
