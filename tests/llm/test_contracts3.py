"""op4, op8 and op10 against brute force, planted passages and held-out labels."""

import hashlib
import random
import struct

import duckdb
import numpy as np
import pytest
import xxhash

from boutlens.llm import queries as registry
from boutlens.llm import line_chunks, substring_dedup
from tests.conftest import SF
from tests.llm.test_contracts import EDGE, docs, edge_dir  # noqa: F401


def line_dedup_brute(rows):
    """What stays of each text: chunks of two lines or more that occur earlier go, whichever of the cuts has them."""
    sg = lambda v: v - (1 << 64) if v >> 63 else v
    h = lambda s: xxhash.xxh64(s.encode(), seed=42).intdigest()
    hl = lambda v, seed: xxhash.xxh64(struct.pack("<Q", v), seed=seed).intdigest()
    chunks, where = {}, {}
    for d, t in rows:
        lines = t.split("\n")
        hs = [h(x) for x in lines]
        for over, seed in line_chunks.ROLLS:
            rolled = []
            for i in range(len(lines)):
                r = 42
                for j in range(max(0, i - over + 1), i + 1):
                    r = hl(hs[j], r)
                rolled.append(sg(hi_spark(seed, r)))
            ends = [i for i, r in enumerate(rolled) if r % line_chunks.SPREAD == 0 or i == len(lines) - 1]
            for before, i in zip([-1, *ends], ends):
                for lo in range(max(0, before), i):
                    begins = (rolled[lo] >> 20) % line_chunks.SPREAD == 0
                    if lo == before + 1 or (begins and i - lo < line_chunks.REACH):
                        chunks.setdefault(d, set()).add((lo, i))
        for lo, i in chunks.get(d, ()):
            where.setdefault("\n".join(lines[lo : i + 1]), []).append((d, lo, i))
    gone = {x for v in where.values() for x in v if x != min(v)}
    out = {}
    for d, t in rows:
        lost = {k for lo, i in chunks.get(d, ()) if (d, lo, i) in gone for k in range(lo, i + 1)}
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
    return out


def hi_spark(value, seed):
    """Spark's xxhash64 of an int."""
    m, p1, p2, p3, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    x = (seed + p5 + 4) & m ^ (value & 0xFFFFFFFF) * p1 & m
    x = ((x << 23 | x >> 41) & m) * p2 + p3 & m
    x ^= x >> 33
    x = x * p2 & m
    x ^= x >> 29
    x = x * p3 & m
    return x ^ x >> 32


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op10(spark, docs, edge_dir, where):  # noqa: F811
    rows = docs if where == "sf" else EDGE
    got = registry.queries()["op10_line_chunks"](spark, SF if where == "sf" else edge_dir).toPandas().set_index("doc_id")
    texts = [(int(i), t) for i, t in zip(rows.doc_id, rows.text) if t is not None]
    want = line_dedup_brute(texts)
    assert len(got) == len(rows)
    assert {i: got.text_sha256[i] for i in want} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


@pytest.mark.parametrize("least", [2, 3, 5])
def test_op10_recall(spark, least):
    """Of lines in runs of two, three, five or more that occur earlier, not all of them one line over and over, nine tenths go."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id").fetchall()
    whole, kept = {}, []
    for d, t in rows:
        if whole.setdefault(t, d) == d:
            kept.append((d, t))
    seen, covered = {}, {}
    for d, t in kept:
        lines = t.split("\n")
        for i in range(len(lines) - least + 1):
            run = tuple(lines[i : i + least])
            if len(set(run)) > 1 and seen.setdefault(run, (d, i)) != (d, i):
                covered.setdefault(d, set()).update(range(i, i + least))
    df = spark.createDataFrame(kept, "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in line_chunks.dedup_lines(df).collect()}
    total = sum(map(len, covered.values()))
    assert total > 20 and sum(min(got[d], len(s)) for d, s in covered.items()) >= 0.9 * total


def test_op8(spark):
    got = registry.queries()["op8_rule_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("auc", auc, "accuracy", (held.predicted == held.quality).mean(), len(held))
    assert auc > 0.85
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_op4_planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(80)]
    fuzzy = list(passage)
    for i in (11, 30, 31, 57):
        fuzzy[i] = word()
    del fuzzy[44]
    pad = lambda n: [word() for _ in range(n)]
    rows = [(1, pad(50) + passage + pad(30)), (2, pad(20) + fuzzy + pad(60)), (3, pad(200)), (4, passage), (5, pad(10) + passage[:20] + pad(50))]
    data = [(i, " ".join(w), "x") for i, w in rows] + [(6, None, None), (7, "", None), (None, "a b", None)]
    out = substring_dedup.dedup_passages(spark.createDataFrame(data, "doc_id long, text string, other string"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "other", "removed"] and len(got) == len(data)
    for i in (1, 3, 5):
        assert got[i].text == " ".join(dict(rows)[i])
    assert [(r.start, r.stop, r.source) for r in got[2].removed] == [(20, 99, 1)]
    assert got[4].text == "" and got[6].text is None and got[7].text == "" and got[None].text == "a b"


def test_op4_recall(spark):
    """Planted passages: exact ones from LEAST_WORDS words on all go, longer ones with a few words changed nearly all."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, plan = {}, {}
    for size, edits in ((40, 0), (41, 0), (60, 0), (60, 1), (60, 3), (80, 3)):
        for _ in range(25):
            k = len(docs)
            passage = [word() for _ in range(size)]
            changed = list(passage)
            for i in rng.sample(range(size), edits):
                changed[i] = word()
            for d, part in ((k, passage), (k + 1, changed)):
                own = [word() for _ in range(rng.randrange(60, 200))]
                at = rng.randrange(len(own))
                docs[d] = own[:at] + part + own[at:]
            plan[k + 1] = (size, edits)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    left = {r.doc_id: len(r.text.split()) for r in substring_dedup.dedup_passages(df).collect()}
    found = {}
    for d, case in plan.items():
        found.setdefault(case, []).append(min(1, (len(docs[d]) - left[d]) / case[0]))
    for (size, edits), shares in found.items():
        assert sum(s >= 0.8 for s in shares) >= (len(shares) if not edits else 0.9 * len(shares)), (size, edits)
    assert all(left[d] == len(docs[d]) for d in docs if d not in plan)


def test_alignment_against_brute():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        assert substring_dedup.differences(a, b) == row[-1]
