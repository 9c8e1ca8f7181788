"""The near-dedup stage against brute-force shingle similarity."""

import random

import numpy as np

from boutlens.llm import simhash
from boutlens.llm.common import components

SCHEMA = "doc_id long, text string"


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def edited(words, places, rng):
    out = list(words)
    for i in places:
        out[i] = word(rng)
    return out


def left(spark, docs):
    return {r.doc_id for r in simhash.drop_near(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], SCHEMA)).collect()}


def test_recall_against_brute(spark):
    """Copies of 200 words with 1 to 5 words changed: similarity from about 0.95 down to below 0.8."""
    rng = random.Random(3)
    docs = {}
    for k in range(60):
        words = [word(rng) for _ in range(200)]
        docs[k], docs[100 + k] = words, edited(words, rng.sample(range(200), 1 + k % 5), rng)
    near = {k for k in range(60) if simhash.similarity(" ".join(docs[k]), " ".join(docs[100 + k])) >= 0.8}
    far = {k for k in near if (simhash.simhash(" ".join(docs[k]), 5) ^ simhash.simhash(" ".join(docs[100 + k]), 5)).bit_count() > 3}
    assert len(far) > 30 and len(near) < 60
    assert left(spark, docs) == docs.keys() - {100 + k for k in near}


def test_chain_of_copies(spark):
    """Later documents under 0.8 to the first of their group, but 0.8 or more to each other: one of those stays."""
    rng = random.Random(4)
    words = [word(rng) for _ in range(200)]
    docs = {0: words, 1: edited(words, (20, 60, 100), rng)}
    docs[2] = edited(docs[1], (140, 180), rng)
    for k in (3, 4, 5):
        docs[k] = edited(docs[2], (30 * k,), rng)
    alike = {(i, j) for i in docs for j in docs if i < j and simhash.similarity(" ".join(docs[i]), " ".join(docs[j])) >= 0.8}
    assert (0, 1) in alike and (0, 2) not in alike and {(2, 3), (2, 4), (2, 5)} <= alike
    kept = []
    for i in docs:
        if not any((j, i) in alike for j in kept):
            kept.append(i)
    assert left(spark, docs) == set(kept) == {0, 2}


def test_links_of_divided_keys(spark):
    """Keys of more than a few fingerprints are divided and lose no link: a cluster around one point, brute force."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        x = centre
        for _ in range(rng.randrange(1, 9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    comp = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)]
    reps = spark.createDataFrame(signed, "fp long, node long")
    for crowd in (8, 40, 1000):
        got = {r.node: r.component for r in components(simhash.links(reps, crowd)).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == comp


def sequential(docs):
    """The documents that stay: in the order of doc_id, those under 0.8 to all that stay before them."""
    sets = {i: set(zip(*(w[k:] for k in range(5)))) for i, w in docs.items()}
    kept = []
    for i in sorted(docs):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept):
            kept.append(i)
    return set(kept)


def chained(rng, links, words=100):
    """Documents each of which is like the one before, and ever less like the first."""
    docs = [[word(rng) for _ in range(words)]]
    while len(docs) < links:
        docs.append(edited(docs[-1], rng.sample(range(10, words - 10), 1), rng))
    return docs


def test_the_sequential_rule_for_any_chunk(spark):
    """Chains, groups of copies and lone texts: what stays doesn't depend on how groups and keys are dealt out."""
    rng = random.Random(5)
    words = [word(rng) for _ in range(120)]
    texts = [t for links in (3, 12, 60) for t in chained(rng, links)]
    texts += [edited(words, rng.sample(range(120), 1), rng) for _ in range(120)] + [[word(rng) for _ in range(100)] for _ in range(20)]
    order = rng.sample(range(0, 10 * len(texts), 10), len(texts))
    docs = dict(zip(order, texts))
    want = sequential(docs)
    assert 30 < len(want) < len(docs) - 120
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in docs.items()], "doc_id long, text string, __hit string")
    for chunk in (2, 10, 1000):
        assert {r.doc_id for r in simhash.drop_near(df, chunk=chunk, key_chunk=5000).collect()} == want


def test_what_a_lost_document_beat_stays(spark):
    """2 is like 3 and 3 is like 4, but 2 isn't like 4: 4 stays, as 3 goes."""
    rng = random.Random(1)
    a = [word(rng) for _ in range(60)]
    b = edited(a, (10,), rng)
    c = edited(b, (40,), rng)
    docs = {2: a, 3: b, 4: c}
    assert sequential(docs) == {2, 4}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], SCHEMA)
    for chunk in (1, 1000):
        assert {r.doc_id for r in simhash.drop_near(df, chunk=chunk).collect()} == {2, 4}


def test_divided_keys_of_the_near_stage(spark):
    """Texts that share half their shingles crowd the keys of that half; keys are divided and no candidate is lost."""
    rng = random.Random(6)
    shared = [word(rng) for _ in range(120)]
    docs = {i: shared + [word(rng) for _ in range(60)] for i in range(60)}
    docs |= {1000 + i: edited(docs[i], (150,), rng) for i in range(0, 60, 3)}
    want = sequential(docs)
    assert want == set(range(60))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], SCHEMA)
    crowd = simhash._sketches(df, 5).selectExpr("explode(keys) k").groupBy("k").count().agg({"count": "max"}).first()[0]
    assert crowd > 30
    assert {r.doc_id for r in simhash.drop_near(df, key_chunk=25).collect()} == want


def test_the_tables_by_the_sequential_rule(spark):
    """Over sf0.01 by pairs that share a shingle: recall of like pairs, and the documents that stay for two chunks."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    held = {r.doc_id: simhash.shingle_hashes(r.text) for r in rows.collect()}
    holders = {}
    for i in sorted(held):
        for x in held[i][: len(held[i]) // 5 + 1].tolist():
            holders.setdefault(x, []).append(i)
    pairs = set()
    for ids in holders.values():
        for j in ids:
            for i in ids:
                if i < j and (i, j) not in pairs:
                    both = len(set(held[i].tolist()) & set(held[j].tolist()))
                    if both / (len(held[i]) + len(held[j]) - both) >= 0.8:
                        pairs.add((i, j))
    gone = set()
    for j in sorted(held):
        if any((i, j) in pairs and i not in gone for i in held if i < j):
            gone.add(j)
    found = {r.node: r.component for r in components(simhash.candidates(rows)).collect()}
    met = sum(found.get(i) is not None and found.get(i) == found.get(j) for i, j in pairs)
    assert len(pairs) >= 5 and met == len(pairs)
    for chunk in (5, 1000):
        kept = {r.doc_id for r in simhash.drop_near(rows, chunk=chunk).collect()}
        assert kept == held.keys() - gone


def test_fingerprints_choose_the_candidates(spark):
    """Brute force over the fingerprints: who shares two slices of a key within WIDE bits is one component, whatever the keys' size."""
    rng = random.Random(12)
    words = [word(rng) for _ in range(150)]
    texts = [edited(words, rng.sample(range(150), rng.randrange(1, 4)), rng) for _ in range(30)]
    texts += [t for links in (4, 9) for t in chained(rng, links)] + [words[:75] + [word(rng) for _ in range(75)] for _ in range(20)]
    bits = [simhash.prints(simhash.shingle_hashes(" ".join(t))) for t in texts]
    pairs = []
    for y, b in enumerate(bits):
        for x, a in enumerate(bits[:y]):
            apart = sum(int(p ^ q).bit_count() for p, q in zip(a[:16], b[:16]))
            if apart <= simhash.WIDE and any(a[i] == b[i] and a[j] == b[j] for i, j in simhash._KEYS):
                pairs.append((x, y))
    comp = list(range(len(texts)))
    for x, y in pairs:
        comp = [min(comp[x], comp[y]) if c in (comp[x], comp[y]) else c for c in comp]
    assert len(set(comp)) > 5 and len(pairs) > 50
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.node: r.component for r in components(simhash.candidates(df)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == comp
    got = {r.node: r.component for r in components(simhash.candidates(df, chunk=8)).collect()}
    assert all(got[x] == got[y] for x, y in pairs)


def test_links_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Near copies of one text: what is linked between rounds grows with the copies; their pairs would be 36 times as many."""
    rng = random.Random(13)
    words = [word(rng) for _ in range(200)]
    linked, whole = [], simhash.components

    def counted(edges):
        linked.append(edges.count())
        return whole(edges)

    monkeypatch.setattr(simhash, "components", counted)
    most = {}
    for n in (50, 300):
        df = spark.createDataFrame([(i, " ".join(edited(words, rng.sample(range(200), 2), rng))) for i in range(n)], SCHEMA)
        linked.clear()
        got = {r.v: r.u for r in simhash.candidates(df).collect()}
        assert got == dict.fromkeys(range(n), 0)
        most[n] = max(linked)
    assert most[300] <= 4 * 300 and most[300] <= 10 * most[50]


def test_forest_against_brute():
    rng = np.random.default_rng(14)
    for n, pairs in ((1, 0), (2, 1), (40, 25), (40, 60), (300, 5000)):
        ids = rng.permutation(10 * n)[:n]
        u, v = (ids[rng.integers(0, n, pairs)] for _ in range(2))
        comp = {int(i): int(i) for i in np.concatenate([u, v])}
        for p, q in zip(u.tolist(), v.tolist()):
            a, b = comp[p], comp[q]
            comp = {i: min(a, b) if c in (a, b) else c for i, c in comp.items()}
        least, below = simhash._forest(u, v)
        assert dict(zip(below.tolist(), least.tolist())) == {i: c for i, c in comp.items() if i != c}
    u, v = np.arange(3000)[:-1], np.arange(3000)[1:]
    assert (simhash._forest(u, v)[0] == 0).all()
