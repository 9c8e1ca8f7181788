"""Tiers of names on crowded cards: those of one last name are counted, not compared with each name asked."""

import datetime
import random

from boutlens.operators import names

DAY = datetime.date(2020, 1, 1)


def test_first_tiers_equal_loops(spark):
    """Repeated fighters, no names, initials and several first names; a fighter isn't hit twice."""
    rng = random.Random(4)
    firsts, lasts = ["Ann", "Al", "Bo", "A", "B", "Cy"], ["X", "Y", "Z"]
    name = lambda: " ".join([*rng.sample(firsts, rng.randrange(3)), rng.choice(lasts)])
    days = [DAY + datetime.timedelta(i) for i in range(12)]
    card = [(d, 100 * i + j, name()) for i, d in enumerate(days) for j in range(rng.randrange(1, 8))]
    card += rng.sample(card, 5) + [(DAY, None, "Bo X"), (DAY, 77, None), (None, 78, "Bo X"), (DAY, 79, "")]
    asked = [(i, name(), rng.choice(days)) for i in range(400)] + [(400, None, DAY), (401, "", DAY), (402, "Bo X", None)]
    got = {r.id: (r.match, r.tier) for r in names.alias_tiers(
        spark.createDataFrame(asked, "id long, name string, day date"), spark.createDataFrame(card, "day date, fighter long, fighter_name string"), spark.createDataFrame([], "alias string, canonical string, tier int")).collect()}
    assert len(got) == len(asked)
    seen = set()
    for i, n, d in asked:
        *own, last = (n or "").lower().split() or [None]
        people = {(f, (m or "").lower()) for e, f, m in card if e == d and d is not None and m and m.lower().split()[-1:] == [last]}
        hits = {f for f, m in people if any(k in m.split()[:-1] or len(k) == 1 and any(c.startswith(k) for c in m.split()[:-1]) for k in own)}
        same = {f for f, _ in people if f is not None}
        if len(hits) == 1 and not (len(same) > 1 and any(len(k) <= 1 for k in own)) and None not in hits:
            assert got[i] == (*hits, "1")
            seen.add(1)
        elif len(same) == 1:
            assert got[i] == (*same, "2")
            seen.add(2)
        else:
            assert got[i][1] in ("6", "no-match", "ambiguous-same-card-lastname")
            assert (got[i][1] == "no-match") <= (len(same) < 2)
            seen.add(got[i][1])
    assert {1, 2, "6", "ambiguous-same-card-lastname", "no-match"} <= seen


def test_one_last_name_on_a_full_card(spark):
    """A thousand of one last name, each asked for: no join grows with their square."""
    card = [(DAY, i, f"F{i} Last") for i in range(1000)]
    asked = spark.createDataFrame([(i, f"F{i} Last", DAY) for i in range(1000)], "id long, name string, day date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = names.alias_tiers(asked, spark.createDataFrame(card, "day date, fighter long, fighter_name string"), spark.createDataFrame([], "alias string, canonical string, tier int"))
        assert {(r.id, r.match, r.tier) for r in out.collect()} == {(i, i, "1") for i in range(1000)}
        plans, counts = [out._jdf.queryExecution().executedPlan()], []
        while plans:
            p = plans.pop()
            plans += [p.children().apply(i) for i in range(p.children().size())]
            if "Join" in p.nodeName():
                counts.append(p.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(counts) > 2 and max(counts) <= 2000
