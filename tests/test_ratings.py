"""The rating fold, the domain pass and the sweeps against a plain fold in Python; the graph against power iteration."""

import datetime
import math
import random

import pytest

from boutlens.functions.odds import RATING
from boutlens.operators import graph, rating

SCHEMA = "fight_id long, event_date date, division string, fighter_a long, fighter_b long, winner long, method string, detail string, seed_a double, seed_b double"
D = datetime.date


def plain_fold(rows, c=RATING, loose=("Catch Weight", "Open Weight")):
    """{(fight, fighter): (before, after, shown, k, expected of a)} of bouts in order."""
    r, n, last, div, out = {}, {}, {}, {}, {}
    for f, day, d, a, b, w, method, detail, sa, sb in sorted(rows, key=lambda x: (x[1], x[0])):
        if w is None and method in (None, "Other", "No Contest"):
            continue
        for x in (a, b):
            gap = (day - last[x]).days if x in last else 0
            if gap > c["idle_days"]:
                pull = min((gap - c["idle_days"]) / 30 * c["idle_rate"], c["idle_most"])
                for k in [k for k in r if k[0] == x]:
                    r[k] = r[k] - (r[k] - c["initial"]) * pull
            if d not in loose and div.get(x) not in (None, d) and (x, d) not in r:
                r[x, d] = c["initial"] + c["transfer"] * (r.get((x, div[x]), c["initial"]) - c["initial"])
        ra, rb = r.get((a, d), c["initial"] if sa is None else sa), r.get((b, d), c["initial"] if sb is None else sb)
        ea = 1 / (1 + 10 ** ((rb - ra) / 400))
        if w is None:
            m = c["draw"]
        elif method in ("KO/TKO", "TKO"):
            m = c["ko"]
        elif method in ("Submission", "SUB"):
            m = c["submission"]
        elif method == "S-DEC" or (method == "Decision" and (detail or "").strip() == "Split"):
            m = c["split"]
        else:
            m = c["dq"] if method == "DQ" else c["unanimous"]
        for x, before, e, res in ((a, ra, ea, 0.5 if w is None else float(w == a)), (b, rb, 1 - ea, 0.5 if w is None else float(w == b))):
            k = (c["k_first"] if n.get(x, 0) < c["k_bouts"] else c["k_later"]) * m
            after = before + k * (res - e)
            out[f, x] = (before, after, c["initial"] + (after - c["initial"]) * min((n.get(x, 0) + 1) / c["shrink_bouts"], 1), k, ea, w, day)
            r[x, d] = after
        for x in (a, b):
            n[x], last[x] = n.get(x, 0) + 1, day
            if d not in loose:
                div[x] = d
    return out


def made(seed, bouts=400, fighters=30):
    rng = random.Random(seed)
    rows = []
    for i in range(bouts):
        group = rng.randrange(3) * 100  # three components
        a, b = rng.sample(range(fighters // 3), 2)
        a, b = group + a, group + b
        day = D(2000, 1, 1) + datetime.timedelta(rng.randrange(4000))
        method, detail = rng.choice([("KO/TKO", None), ("Submission", None), ("Decision", "Split"), ("Decision", "Unanimous"), ("DQ", None), (None, None), ("Other", None), ("S-DEC", None), ("M-DEC", None)])
        rows.append((i, day, rng.choice(["Lightweight", "Welterweight", "Catch Weight"]), a, b, rng.choice([a, b, None]), method, detail, 1550.0 if a % 7 == 0 else None, 1550.0 if b % 7 == 0 else None))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(3)


def test_overall(spark, rows):
    want = plain_fold(rows)
    got = {(r.fight_id, r.fighter): r for r in rating.overall(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    for k, (before, after, shown, step, *_) in want.items():
        assert (got[k].before, got[k].after, got[k].shown, got[k].k) == pytest.approx((before, after, shown, step), abs=1e-9)


def test_domains(spark, rows):
    """Grappling never regresses or carries over, striking does; both count towards the displayed rating."""
    want = plain_fold(rows)
    shares = {r[0]: (r[0] % 5) / 4 for r in rows if r[0] % 6}
    df = spark.createDataFrame(rows, SCHEMA)
    s = spark.createDataFrame([(f, x, 1 - x) for f, x in shares.items()], "fight_id long, striking double, grappling double")
    got = {(r.fight_id, r.fighter, r.domain): r for r in rating.domains(rating.overall(df), s).collect()}
    ratings, last, div, n = {"striking": {}, "grappling": {}}, {}, {}, {}
    seen = 0
    for f, day, d, a, b, *_ in sorted(rows, key=lambda x: (x[1], x[0])):
        if f not in shares or (f, a) not in want:
            continue
        for domain, share in (("striking", shares[f]), ("grappling", 1 - shares[f])):
            r = ratings[domain]
            for x in (a, b):
                gap = (day - last[x]).days if x in last else 0
                if gap > 270:
                    for k in [k for k in r if k[0] == x]:
                        r[k] -= (r[k] - 1500) * min((gap - 270) / 300, 0.5)
                if d != "Catch Weight" and div.get(x) not in (None, d) and (x, d) not in r:
                    r[x, d] = 1500 + 0.5 * (r.get((x, div[x]), 1500) - 1500)
                before = r.get((x, d), 1500)
                r[x, d] = before + (want[f, x][1] - want[f, x][0]) * share
                n[x], last[x] = n.get(x, 0) + 1, day
                if d != "Catch Weight":
                    div[x] = d
                row = got[f, x, domain]
                assert (row.before, row.after, row.shown) == pytest.approx((before, r[x, d], 1500 + (r[x, d] - 1500) * min(n[x] / 5, 1)), abs=1e-9)
                seen += 1
    assert seen == len(got) > 500


def test_backtest(spark, rows):
    rows = [(*r[:8], None, None) for r in rows]
    configs = [RATING, RATING | {"k_first": 60.0, "k_bouts": 3}, RATING | {"idle_days": 365, "idle_most": 0.75}, RATING | {"ko": 1.8, "split": 1.0, "transfer": 1.0}]
    split = D(2006, 1, 1)
    got = {r.config: r for r in rating.backtest(spark.createDataFrame(rows, SCHEMA), configs, split).collect()}
    for i, c in enumerate(configs):
        judged = {f: v for (f, x), v in plain_fold(rows, c).items() if v[6] >= split and v[5] is not None}
        first = {r[0]: r[3] for r in rows}
        pairs = [(v[4], float(v[5] == first[f])) for f, v in judged.items()]
        assert got[i].n == len(pairs)
        assert got[i].brier == pytest.approx(sum((p - y) ** 2 for p, y in pairs) / len(pairs))
        assert got[i].accuracy == pytest.approx(sum((p >= 0.5) == (y == 1) for p, y in pairs) / len(pairs))


def test_components(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 3), (None, 7), (20, 20)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 20}


TOY = [(D(2010, 1, 1), 1, 2, "KO/TKO"), (D(2010, 6, 1), 1, 3, "Decision"), (D(2011, 1, 1), 2, 3, "KO/TKO"), (D(2011, 6, 1), 4, 1, "Submission"), (D(2018, 1, 1), 5, 4, "KO/TKO"),
       (D(2018, 6, 1), 5, 1, "Decision"), (D(2024, 1, 1), 5, 2, "Decision"), (D(2024, 6, 1), 5, 3, "KO/TKO")]


def plain_rank(edges):
    nodes = sorted({x for e in edges for x in e[:2]})
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    x = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        dangling = sum(v for k, v in x.items() if k not in out)
        new = {k: 0.15 / len(nodes) + 0.85 * dangling / len(nodes) for k in nodes}
        for s, d, w in edges:
            new[d] += 0.85 * x[s] * w / out[s]
        moved = sum(abs(new[k] - x[k]) for k in nodes)
        x = new
        if moved < len(nodes) * 1e-6:
            break
    return x


@pytest.mark.parametrize("most", [0, graph.MOST_EDGES])
@pytest.mark.parametrize("decay", [None, graph.DECAY])
def test_pagerank_asof(spark, decay, most):
    """Only earlier edges count, a node without an edge has no rank, one without a win no schedule."""
    weight = {"KO/TKO": 1.2, "Submission": 1.1, "Decision": 1.0}
    bouts = spark.createDataFrame([(i, d, w, l, w, m) for i, (d, w, l, m) in enumerate(TOY)], "fight_id long, event_date date, fighter_a long, fighter_b long, winner long, method string")
    days = [D(2010, 1, 1), D(2011, 1, 1), D(2018, 6, 1), D(2025, 1, 1)]
    got = {}
    for r in graph.pagerank_asof(graph.edges(bouts), spark.createDataFrame([(d,) for d in days], "as_of date"), decay, most).collect():
        got.setdefault(r.as_of, {})[r.node] = (r["rank"], r.sos)
    assert days[0] not in got
    for day in days[1:]:
        known = [(l, w, weight[m] * (decay ** (day - d).days if decay else 1)) for d, w, l, m in TOY if d < day]
        rank = plain_rank(known)
        assert got[day].keys() == rank.keys()
        for node, value in rank.items():
            beaten = [rank[s] for s, d, _ in known if d == node]
            assert got[day][node][0] == pytest.approx(value, abs=1e-9)
            assert got[day][node][1] == pytest.approx(sum(beaten) / len(beaten)) if beaten else got[day][node][1] is None


def test_seven_thousand_bouts(spark):
    """The one timing that is known of: 7,000 bouts of 500 fighters in under 30 seconds."""
    import time

    rng = random.Random(1)
    rows = []
    for i in range(7000):
        a, b = rng.sample(range(500), 2)
        rows.append((i, D(2000, 1, 1) + datetime.timedelta(i // 3), "Lightweight", a, b, rng.choice([a, b]), "Decision", None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.perf_counter()
    assert rating.overall(df).count() == 14000
    assert time.perf_counter() - began < 30
    assert math.isfinite(began)
