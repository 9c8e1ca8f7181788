"""Fuzzy names against brute force, tiers of aliases, learners' invariants, streams against batches."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.operators import evaluation, matching, models, names
from boutlens.streaming import records

D = datetime.date


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_indel_ratio():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(12))) for _ in "ab")
        want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert names.indel_ratio(a, b) == pytest.approx(want)


def test_best_match(spark):
    left = [(1, "Ovince Saint-Preux", 1), (2, "Jones, Jon", 1), (3, "Jon Jones", 2), (4, "Somebody Else", 1)]
    right = [(10, "St. Preux, Ovince", 1), (11, "Jon Jones", 1), (12, "Jon Jones", 1), (13, "Someone Other", 1)]
    s = "left_id long, left_name string, card int"
    got = {r.left_id: (r.right_id, r.score) for r in names.best_match(spark.createDataFrame(left, s), spark.createDataFrame(right, s.replace("left", "right")), ["card"], 80.0).collect()}
    assert got == {1: (10, 100.0), 2: (11, 100.0)}


def test_places(spark):
    left = spark.createDataFrame([(1, "  T-Mobile  ARENA, Las Vegas"), (2, "Las Vegas, T-Mobile Arena"), (3, "Moon")], "left_id long, left_name string")
    right = spark.createDataFrame([(7, "T-Mobile Arena, Las Vegas"), (8, "O2 Arena, London")], "right_id long, right_name string")
    got = {r.left_id: (r.right_id, r.kind) for r in names.exact_then_fuzzy(left, right).collect()}
    assert got[1] == (7, "exact") and got[2][0] == 7 and got[2][1].startswith("fuzzy:") and 3 not in got


def test_alias_tiers(spark):
    day = D(2020, 1, 1)
    card = [(day, 1, "Anderson Silva"), (day, 2, "Antonio Silva"), (day, 3, "Mirko Filipović"), (day, 4, "Jose Aldo"), (day, 5, "Mike Brown Smith"), (D(2019, 1, 1), 9, "Miranda Maverick")]
    asked = ["Anderson Silva", "A. Silva", "Cro Filipovic", "Scarface", "Miranda M", "Smith Mike Brown", "B Silva", "Nobody"]
    registry = [("scarface", "Jose Aldo", 3), ("miranda m", "Miranda Maverick", 4)]
    out = names.alias_tiers(
        spark.createDataFrame([(i, n, day) for i, n in enumerate(asked)], "id long, name string, day date"), spark.createDataFrame(card, "day date, fighter long, fighter_name string"),
        spark.createDataFrame(registry, "alias string, canonical string, tier int"),
    )
    got = {asked[r.id]: (r.match, r.tier, r.confidence) for r in out.collect()}
    assert got == {
        "Anderson Silva": (1, "1", "high"), "A. Silva": (None, "ambiguous-same-card-lastname", "requires-manual-review"), "Cro Filipovic": (3, "2", "med"), "Scarface": (4, "3", "med"),
        "Miranda M": (9, "4", "low"), "Smith Mike Brown": (5, "6", "med"), "B Silva": (None, "ambiguous-same-card-lastname", "requires-manual-review"), "Nobody": (None, "no-match", "requires-manual-review"),
    }


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.standard_normal((n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + 0.5 * x[:, 0] * x[:, 1])))).astype(int)
    rows = [(i, D(2000, 1, 1) + datetime.timedelta(i // 2), *map(float, v), int(o)) for i, (v, o) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "fight_id long, event_date date, a double, b double, c double, y int").coalesce(2).cache()


def test_embeddings(spark, frame):
    pdf = frame.toPandas()
    got = models.embeddings(frame, ["a", "b", "c"], 2).toPandas().sort_values("fight_id")
    z = pdf.sort_values("fight_id")[["a", "b", "c"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    values, axes = np.linalg.eigh(z.T @ z)
    want = z @ axes[:, ::-1][:, :2]
    emb = np.array(got.embedding.tolist())
    emb -= emb.mean(0)
    assert np.allclose(np.abs(emb), np.abs(want), atol=1e-6)


def test_folds_and_stacker(spark, frame):
    marked = evaluation.folds(frame, 3, ["event_date", "fight_id"]).toPandas().sort_values("position")
    assert marked.fight_id.tolist() == list(range(400)) and marked.position.tolist() == list(range(400))
    assert marked.groupby("fold").size().tolist() == [100] * 4 and marked.fold.is_monotonic_increasing
    out = models.out_of_fold(frame, 3, ["event_date", "fight_id"], models.stacker(["a", "b", "c"], rows=400).fit, guard=False)
    assert out.count() == 300 and models.brier(out) < 0.24
    leak = frame.withColumn("a", F.col("y").cast("double"))
    with pytest.raises(ValueError, match="know the outcome"):
        models.out_of_fold(leak, 3, ["event_date", "fight_id"], models.stacker(["a", "b"], rows=400).fit)


def test_boosted_and_calibrated(spark, frame):
    rows = models.assembled(frame, ["a", "b", "c"])
    tries = [{"maxDepth": 2, "maxIter": 3}, {"maxDepth": 1, "maxIter": 1, "stepSize": 0.01}]
    best, score = models.search(rows, 2, ["event_date", "fight_id"], tries)
    scores = [models.brier(models.out_of_fold(rows, 2, ["event_date", "fight_id"], models.boosted(**t).fit, guard=False)) for t in tries]
    assert score == pytest.approx(min(scores)) and best == tries[scores.index(min(scores))]
    train, test = rows.filter("fight_id < 300"), rows.filter("fight_id >= 300")
    blend = models.ensemble(train, test).select("fight_id", "y", "p")
    out = models.calibrated(blend, models.probability(models.boosted(maxDepth=2, maxIter=3).fit(train), test).select("fight_id", "y", "p"))
    assert out.count() == 100 and out.filter("p < 0 or p > 1 or p is null").isEmpty()


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.random(500)] + [("b", 0.25)] * 50
    got = {r.slice: r for r in models.bootstrap_intervals(spark.createDataFrame(rows, "slice string, v double"), "slice", "v").collect()}
    a = np.array([v for s, v in rows if s == "a"])
    assert got["a"].n == 500 and got["a"]["mean"] == pytest.approx(a.mean(), abs=1e-6)
    assert got["a"].half == pytest.approx(a.std() / np.sqrt(500), rel=0.15) and got["b"].half is None
    copies = models.resampled(spark.range(2000).withColumnRenamed("id", "k"), 3, "k").groupBy("seed").count().toPandas()
    assert (abs(copies["count"] - 2000) < 200).all() and copies["count"].nunique() > 1


def test_slices_and_medians(spark):
    rows = spark.createDataFrame([(s, k, 0.2 + s / 100, 0.6) for s in range(5) for k in ("x", "y")], "seed int, slice string, brier double, accuracy double")
    m = evaluation.thresholds(evaluation.seed_medians(rows), 0.7).orderBy("slice").first()
    assert (m.median_brier, m.brier_max, m.accuracy_min, m.breach, m.seeds_differ) == (pytest.approx(0.22), pytest.approx(round(0.22 - np.std([0, .01, .02, .03, .04], ddof=1), 4)), 0.7, True, True)


def test_as_of_ties(spark):
    """Strictly before: a state of the same time doesn't count; at or before: it does; rows without any stay."""
    left = spark.createDataFrame([(1, 5, "p"), (1, 6, "q"), (2, 1, "r")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 5, 10), (1, 2, 7)], "k long, t long, v long")
    strict = {r.name: (r.last_t, r.last_v) for r in matching.asof_backward(left, right, "k", "t", ["v"]).collect()}
    loose = {r.name: (r.last_t, r.last_v) for r in matching.asof_backward(left, right, "k", "t", ["v"], strict=False).collect()}
    assert strict == {"p": (2, 7), "q": (5, 10), "r": (None, None)} and loose["p"] == (5, 10)


def test_stream_of_bouts(spark, tmp_path):
    """Records after the last micro-batch equal a plain pass; late windows are left out."""
    rng = random.Random(3)
    rows = [(i, D(2000, 1, 1) + datetime.timedelta(i), f, rng.choice([0, 1, None])) for i in range(60) for f in (1, 2)]
    schema = "fight_id long, event_date date, fighter long, won int"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{part}")
    stream = records.read_files(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, 1)
    running = records.running_record(stream).writeStream.outputMode("update").format("memory").queryName("record_test").trigger(availableNow=True).start()
    running.awaitTermination()
    got = {}
    for r in spark.table("record_test").collect():
        if r.bouts >= got.get(r.fighter, (0,))[0]:
            got[r.fighter] = (r.bouts, r.wins, r.streak, round(r.ewma, 9))
    for f in (1, 2):
        own = [w for *_, x, w in rows if x == f]
        streak, ewma = 0, None
        for w in own:
            streak = streak + 1 if w == 1 else 0
            if w is not None:
                ewma = float(w) if ewma is None else ewma * 0.794 + w * 0.206
        assert got[f] == (60, sum(w == 1 for w in own), streak, round(ewma, 9))


def test_compositions(spark):
    """Promotion needs limits, margin and all steps; some steps alone are path b, an unknown score is path c."""
    s = "candidate string, brier double, baseline double, accuracy double, brier_max double, accuracy_min double"
    rows = [(c, b, 0.21, 0.7, 0.208, 0.65) for c, bs in {"good": (0.2, 0.19), "thin": (0.2, 0.2085), "part": (0.2, 0.2), "nan": (0.2, float("nan"))}.items() for b in bs]
    steps = [("good", True), ("good", True), ("thin", True), ("thin", False), ("part", True), ("part", False), ("nan", True), ("nan", False)]
    out = evaluation.composition(spark.createDataFrame(rows, s), spark.createDataFrame(steps, "candidate string, clears boolean"))
    assert {r.candidate: (r.verdict, r.path) for r in out.collect()} == {"good": ("promote", "path_a"), "thin": ("reject", "path_b"), "part": ("reject", "path_b"), "nan": ("reject", "path_c")}
    d = [("x", 0.01, 0.25, True), ("x", 0.02, 0.3, True), ("x", 0.3, 0.3, True), ("y", 0.1, 0.1, True), ("y", 0.1, 0.1, True), ("z", 0.1, 0.1, False), ("z", 0.1, 0.1, True)]
    got = {r.candidate: r.verdict for r in evaluation.divergence(spark.createDataFrame(d, "candidate string, remeasured double, reported double, clears boolean")).collect()}
    assert got == {"x": "artifact", "y": "real", "z": "real_but_floor_misses"}


def test_drop_policies(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1.0), (0.5, None, 1.0), (0.5, 0.5, None)], "xgb_oof_prob double, elo_prob double, extra double")
    assert evaluation.nan_drop(df, df.columns).count() == 1 and evaluation.nan_drop(df, df.columns, "per_feature_strict_baseline").count() == 2
    with pytest.raises(KeyError):
        evaluation.nan_drop(df, ["extra"], "per_feature_strict_baseline")
    with pytest.raises(ValueError):
        evaluation.nan_drop(df, df.columns, "other")
    full = spark.createDataFrame([("a", 4), ("b", 2)], "slice string, expected long")
    got = {r.slice: (r.rows, r.passes) for r in evaluation.slice_coverage(spark.createDataFrame([("a",)] * 3, "slice string"), full).collect()}
    assert got == {"a": (3, True), "b": (0, False)}


def test_feature_sets():
    from boutlens.operators import matrix

    assert [len(matrix.feature_columns(s)) for s in ("v1.0", "v2.1-no-net", "v2.2", "v2.5-travel", "no-odds")] == [75, 72, 90, 92, 67]
    assert set(matrix.LEVEL_ONE[2:]) <= set(matrix.feature_columns("v2.2")) and len(matrix.LEVEL_ONE) == 13
    with pytest.raises(ValueError):
        matrix.feature_columns("v9")
