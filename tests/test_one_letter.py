"""Names that differ by one letter are found by equality, not among all that are alike."""

import random

import pytest

from boutlens.operators import names


def test_one_apart(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(6)))
    left, right = {word() for _ in range(200)}, {word() for _ in range(200)}
    got = names.one_apart(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")).collect()
    apart = lambda x, y: any(x[:i] + x[i + 1 :] == y for i in range(len(x)))
    want = {(x, y): names.indel_ratio(x, y) for x in left for y in right if x and y and (apart(x, y) or apart(y, x))}
    assert len(got) == len(want) > 100 and {(r.l, r.r): r.score for r in got} == want


def test_block_of_names_all_alike(spark, monkeypatch):
    """Every pair of a block is alike, but a name without one letter has one best match: no pairs are scored for it."""
    monkeypatch.setattr(names, "similar_pairs", lambda *_: pytest.fail("all pairs of the block were looked up"))
    people = [(i, f"Supplier#{i:09d}") for i in range(3000)]
    left = spark.createDataFrame([(i, n[:3] + n[4:]) for i, n in people], "left_id long, left_name string")
    got = names.best_match(left, spark.createDataFrame(people, "right_id long, right_name string"), [], 80.0).collect()
    assert len(got) == 3000 and all(r.left_id == r.right_id and r.score == names.indel_ratio("suplier000000001", "supplier000000001") for r in got)
