"""The nearest row within a tolerance against all pairs: dense days, ties, nulls."""

import datetime
import random

import pytest

from boutlens.operators import matching


@pytest.mark.parametrize("within", [0, 2, 5])
def test_all_pairs(spark, within):
    rng = random.Random(within)
    day = lambda: rng.choice([None, *(datetime.date(2000, 1, 1) + datetime.timedelta(d) for d in (0, 1, 2, 3, 9, 10, 17, 18, 30))])
    left = [(i, rng.choice(["a", "b", None]), day()) for i in range(120)]
    right = [(i, rng.choice(["a", "b", "c", None]), day()) for i in range(40)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, k string, day date")
    got = {r.left_id: (r.match_id, r.days_apart) for r in matching.asof_nearest(df(left, "left_id"), df(right, "right_id"), ["k"], "left_id", "right_id", "day", within).collect()}
    want = {}
    for i, k, d in left:
        near = [(abs((d - e).days), e, j) for j, m, e in right if k is not None and k == m and d is not None and e is not None and abs((d - e).days) <= within]
        if near:
            want[i] = (min(near)[2], min(near)[0])
    assert got == want and want
