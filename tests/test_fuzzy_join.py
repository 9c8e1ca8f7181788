"""The fuzzy join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from boutlens.operators import names

LETTERS = "aabcdeé -"


def word(rng, least=0, most=14):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(least, most))).strip()


def typo(rng, name):
    out = list(name)
    for _ in range(rng.randrange(0, 5)):
        i = rng.randrange(len(out) + 1)
        if rng.random() < 0.5:
            out.insert(i, rng.choice(LETTERS))
        elif out and i < len(out):
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("threshold", [60.0, 80.0, 85.0, 95.0])
def test_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    right = [(rng.choice("xy"), word(rng)) for _ in range(120)] + [("x", ""), ("x", "a"), ("x", "ab"), ("y", "supplier 000001"), ("y", "q" * 700)]
    left = [(b, typo(rng, n)) for b, n in right for _ in range(2)] + [("x", ""), ("x", "a"), ("y", "supplier 00002"), ("y", "q" * 650), ("z", "ab")]
    got = names.similar_pairs(spark.createDataFrame(left, "b string, l string"), spark.createDataFrame(right, "b string, r string"), ["b"], threshold).collect()
    want = {(b, x, y): names.indel_ratio(x, y) for b, x in set(left) for c, y in set(right) if b == c and names.indel_ratio(x, y) >= threshold}
    assert len(got) == len(want) > 50 and {(r.b, r.l, r.r): r.score for r in got} == want


def test_least_shared_grams():
    """The bound holds for every edited name, and is met by some."""
    rng = random.Random(4)
    for q in (1, 2):
        met = 0
        for _ in range(4000):
            a = word(rng, 2)
            b = typo(rng, a)
            grams = lambda x: [x[i : i + q] for i in range(len(x) - q + 1)]
            if a and b and names.indel_ratio(a, b) >= 80:
                left = grams(b)
                shared = sum(1 for g in grams(a) if g in left and not left.remove(g))
                assert shared >= names._least_shared(len(a), q, 80.0)
                met += shared == max(0, names._least_shared(len(a), q, 80.0))
        assert met


def test_best_match(spark):
    """In a block and without one, by letters and by tokens, either name last name first; ties to the least id."""
    rng = random.Random(9)
    people = [(i, rng.choice("xy"), " ".join(word(rng, 3, 8) or "a" for _ in range(2))) for i in range(60)] + [(90, "x", "Silva, Ana"), (91, "x", "Ana Silva"), (92, "x", "Ana Silva"), (93, "y", None)]
    asked = [(100 + i, b, typo(rng, n)) for i, b, n in people if n] + [(200, "x", "Silva, Ana"), (201, "x", "ana silvaa"), (202, "x", None), (203, "y", "nobody at all")]
    left, right = spark.createDataFrame(asked, "left_id long, b string, left_name string"), spark.createDataFrame(people, "right_id long, b string, right_name string")
    form = {r.n: (r.a, r.f) for r in spark.createDataFrame([(n,) for n in {x[2] for x in (*asked, *people)}], "n string").select("n", names.text.normal_name(F.col("n")).alias("a"), names.text.normal_name(names.reversed_name(F.col("n"))).alias("f")).collect()}
    for blocks in (["b"], []):
        got = {r.left_id: (r.right_id, r.score) for r in names.best_match(left, right, blocks, 80.0).collect()}
        want = {}
        for i, b, n in asked:
            for j, c, m in people:
                if n is not None and m is not None and (b == c or not blocks):
                    (l, fl), (r, fr) = form[n], form[m]
                    s = max(names.indel_ratio(l, r), names.indel_ratio(l, fr) if fr is not None else 0, names.indel_ratio(fl, r) if fl is not None else 0)
                    if s >= 80 and (i not in want or (s, -j) > (want[i][1], -want[i][0])):
                        want[i] = (j, s)
        assert got == want and got[200] == (90, 100.0) and 203 not in got


def test_places_that_share_no_word(spark):
    left = spark.createDataFrame([(1, "Oldtwn Aena"), (2, "madison square gardn"), (3, "The Arena"), (4, "ARENA the")], "left_id long, left_name string")
    right = spark.createDataFrame([(1, "Oldtown Arena"), (2, "Madison Square Garden"), (3, "Arena The"), (4, "Old Town")], "right_id long, right_name string")
    got = {r.left_id: (r.right_id, r.kind) for r in names.exact_then_fuzzy(left, right).collect()}
    assert got[2] == (2, "fuzzy:97") and got[3] == (3, "fuzzy:100") and got[4] == (3, "exact")
    assert got[1] == (1, "fuzzy:91")
