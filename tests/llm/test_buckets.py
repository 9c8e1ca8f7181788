"""A small snapshot and a large batch: buckets are dealt out by the larger of both."""

from pyspark.sql import functions as F

from boutlens.llm import exact_dedup


def test_large_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "DIGESTS_A_BUCKET", 3)
    monkeypatch.setattr(exact_dedup, "MIN_BUCKETS", 2)
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], "doc_id long, text string")
    old = F.col("doc_id") < 20
    exact_dedup.write_filters(docs.filter(old), str(tmp_path / "filters"))
    asked = []
    whole = exact_dedup.screen
    monkeypatch.setattr(exact_dedup, "screen", lambda d, f, b, parts=1: asked.append((b, parts)) or whole(d, f, b, parts))
    for filters in (None, str(tmp_path / "filters")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, ~old, filters=filters).collect()}
        assert got == {i: (600 + i % 300, 3, i >= 600) for i in range(900)}
    assert asked[0][0] >= 100 and asked[0][1] == 1 and asked[1][0] * asked[1][1] >= 100 and asked[1][1] > 1
