"""Every query over rows without ids, repeated rows, very long texts and columns of clashing names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boutlens.llm import common
from boutlens.llm import queries as registry
from boutlens.llm import rule_quality
from tests.conftest import SF

NAMES = ["key", "node", "digest", "removed", "__text", "__hit", "lines", "hashes", "place", "guest", "next", "mark", "fp", "ids", "curve", "score", "spans", "hit", "gone", "word", "bits"]
LONG = "wörter und mehr, ½ ① words\n" * 20000
ROWS = [(None, "no id"), (None, None), (None, "no id"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "another text of the same id"), (2, LONG), (3, LONG), (4, ""), (5, None), (6, "x"), (7, "a b c d e f")]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES)
    spark.createDataFrame([(*r, "en" if (r[0] or 0) % 2 else "de", "s", *NAMES) for r in ROWS], schema).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, 1, 0, "z"), (2, 0, 0, "z"), (2, 0, 0, "z"), (None, 1, 0, "z")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi", "p")], "conv_id long, turn long, role string, text string, path string").write.parquet(f"{base}/conversations.parquet")
    return base


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n not in ("op2_chat_tree", "op7_packing", "op11_hard_negatives")))
def test_rows(spark, odd_dir, name):
    out = registry.queries()[name](spark, odd_dir).toPandas()
    assert out.columns[0] == "doc_id"
    want = [r[0] for r in ROWS if r[0] is not None or name != "op1_simhash"]
    assert sorted(out.doc_id.fillna(-1).astype(int)) == sorted(-1 if i is None else i for i in want)
    if name in ("op3_byte_bpe", "op8_rule_quality", "op9_language_id"):
        one, two = (out[out.doc_id == i].drop(columns=["doc_id", "held_out"], errors="ignore").iloc[0].astype(str).tolist() for i in (2, 3))
        assert one == two


def test_packing(spark, odd_dir):
    out = registry.queries()["op7_packing"](spark, odd_dir).toPandas()
    assert {None if np.isnan(i) else int(i) for i in out.doc_id} == {r[0] for r in ROWS}
    assert (out.start == 0).sum() == len(ROWS)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024


def test_substring_and_lines_of_repeats(spark, odd_dir):
    """A long copy goes from the later document; rows repeated in full share their fate."""
    got = registry.queries()["op4_substring_dedup"](spark, odd_dir).toPandas().set_index("doc_id")
    assert got.removed_words[2] == 0 and got.removed_words[3] > 0.9 * len(LONG.split())
    lines = registry.queries()["op10_line_chunks"](spark, odd_dir).toPandas().set_index("doc_id")
    assert lines.n_lines[2] == lines.n_lines[3] == 20001


def test_rules_without_labels(spark, odd_dir):
    docs, labels = (spark.read.parquet(f"{odd_dir}/{t}.parquet") for t in ("documents", "labels"))
    none = rule_quality.fit(docs, labels.filter("false"), rule_quality.learnable())
    assert none == (0.0, []) and {r.score for r in rule_quality.score(docs, none).collect()} == {0.5}
    one = rule_quality.fit(docs, labels.filter("quality = 1"), rule_quality.learnable())
    assert one[1] == [] and all(r.score > 0.5 for r in rule_quality.score(docs, one).collect())


def test_compiled_rules(spark):
    """The compiled expression scores like the rules held against the statistics one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stats = rule_quality.statistics(F.coalesce("text", F.lit("")))
    x = docs.select("doc_id", *(c.cast("double").alias(k) for k, c in stats.items())).toPandas().sort_values("doc_id")
    values = x[list(stats)].to_numpy()
    rng = np.random.default_rng(4)
    rules = []
    for _ in range(30):
        features = rng.choice(len(stats), rng.integers(1, 4), replace=False)
        rules.append((tuple((int(f), bool(rng.integers(2)), float(np.quantile(values[:, f], rng.random()))) for f in features), float(rng.normal())))
    got = rule_quality.score(docs, (0.3, rules)).toPandas().sort_values("doc_id").score.to_numpy()
    z = 0.3 + sum(w * rule_quality._holds(values, r) for r, w in rules)
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is the penalty where a weight is, and no more where none is."""
    rng = np.random.default_rng(2)
    r = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(r[:, 0] * 2 - r[:, 1])))).astype(float)
    base, w = rule_quality.lasso_logistic(r, y, penalty=0.01)
    gradient = r.T @ (1 / (1 + np.exp(-(base + r @ w))) - y) / len(y)
    used = np.abs(w) > 1e-8
    assert used.any() and not used.all()
    assert np.allclose(gradient[used], -0.01 * np.sign(w[used]), atol=1e-4) and (np.abs(gradient[~used]) <= 0.01 + 1e-4).all()


def test_tree_paths_split_where_impurity_is_least():
    """The first split of a tree of one feature is the best of its cuts, by trying them all."""
    x = np.arange(200.0)[:, None]
    y = (x[:, 0] > 131).astype(float)
    rules = rule_quality.grow(np.hstack([x, x]), y, np.random.default_rng(0))
    first = next(r for r in rules if len(r) == 1)
    assert abs(first[0][2] - 131) < 200 / rule_quality.CUTS


def test_quality_held_out(spark):
    """Held-out rows are ranked by their label, and no label of theirs is read."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_quality.fit(docs, labels, rule_quality.learnable())
    flipped = labels.withColumn("quality", F.when(~rule_quality.learnable(), 1 - labels.quality).otherwise(labels.quality))
    assert rule_quality.fit(docs, flipped, rule_quality.learnable()) == model


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """Long texts reach a worker few at a time while a spool is written; the session keeps its own settings."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(common._BATCH, None)
    long = spark.range(200, numPartitions=1).selectExpr("repeat('x', 1048576) text").mapInArrow(run, "n long")
    assert sum(r.n for r in common.spool(long).collect()) == 200 and max(r.n for r in common.spool(long).collect()) <= 8
    assert spark.conf.get(common._BATCH, None) == before
