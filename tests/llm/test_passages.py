"""Copied passages that one chain to one first holder doesn't give."""

import random

from boutlens.llm import substring_dedup


def cleaned(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    return {r.doc_id: [(s.start, s.stop, s.source) for s in r.removed] for r in substring_dedup.dedup_passages(df).collect()}


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    return lambda n: [word() for _ in range(n)]


def test_two_passages_of_one_source(spark):
    """Own words between two passages of one document are kept, the passages aren't."""
    pad = made(6)
    docs = {}
    for k, own in enumerate((40, 100, 160)):
        one, two = pad(60), pad(60)
        docs[2 * k] = pad(20) + one + pad(own // 2) + two + pad(20)
        docs[2 * k + 1] = pad(30) + one + pad(own) + two + pad(10)
    got = cleaned(spark, docs)
    for k, own in enumerate((40, 100, 160)):
        assert got[2 * k] == []
        assert got[2 * k + 1] == [(30, 90, 2 * k), (90 + own, 150 + own, 2 * k)]


def test_parts_known_from_elsewhere(spark):
    """A passage whose lines of 20 or 30 words occur in earlier documents is cut from the document that holds it whole."""
    pad = made(7)
    for size in (20, 30):
        lines = [pad(size) for _ in range(60 // size)]
        docs = {i: pad(30) + line + pad(30) for i, line in enumerate(lines)}
        passage = sum(lines, [])
        docs[8], docs[9] = pad(25) + passage + pad(25), pad(40) + passage + pad(10)
        got = cleaned(spark, docs)
        assert got.pop(9) == [(40, 100, 8)]
        assert not any(got.values())


def test_repeats_line_up(spark):
    """A line of 12 words ten times over, and a word 80 times, in two documents."""
    pad = made(8)
    line, one = pad(12) * 10, pad(1) * 80
    docs = {1: pad(30) + line + pad(30) + one, 2: pad(10) + line + pad(120) + one + pad(7)}
    got = cleaned(spark, docs)
    assert got[1] == [] and got[2] == [(10, 130, 1), (250, 330, 1)]


def test_alignment_takes_less_than_half_of_the_rows_time():
    """The edit distance equals the row by row one, on words that share little, in less than half of its CPU time."""
    import time

    import numpy as np

    from boutlens.llm.substring_dedup import differences

    def by_rows(a, b):
        y, slope = np.array(b), np.arange(len(b) + 1)
        row = slope.copy()
        for i, w in enumerate(a):
            best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
            row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - slope) + slope
        return int(row[-1])

    rng = np.random.default_rng(3)
    pairs = [[rng.integers(0, 300, rng.integers(1, 700)).tolist() for _ in range(2)] for _ in range(30)]
    begin = time.process_time()
    want = [by_rows(a, b) for a, b in pairs]
    middle = time.process_time()
    assert [differences(a, b) for a, b in pairs] == want
    assert time.process_time() - middle < 0.5 * (middle - begin)


def test_hashes_of_words_take_less_time_than_by_place():
    """Hashes of words equal those that give each byte its place in its word, in less than 0.8 of their CPU time."""
    import time

    import numpy as np

    from boutlens.llm.substring_dedup import word_hashes

    numbers = np.random.default_rng(17).integers(0, 2**64, 257, np.uint64) | np.uint64(1)
    powers = np.cumprod(np.full(4096, numbers[256]), dtype=np.uint64)

    def by_place(texts):
        data = np.frombuffer("".join(" ".join(t.split()) + " " for t in texts).encode(), np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.append(0, ends[:-1] + 1)
        place = np.arange(len(data)) - np.repeat(starts, ends + 1 - starts)
        h = np.add.reduceat(numbers[data] * powers[place & 4095], starts)
        return (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)

    pad = made(9)
    portions = [[" ".join(pad(700)) for _ in range(50)] for _ in range(8)]

    def took(f):
        begin = time.process_time()
        for texts in portions:
            f(texts)
        return time.process_time() - begin

    for texts in portions:
        h, n = word_hashes(texts)
        assert np.array_equal(h, by_place(texts)) and n.tolist() == [700] * 50
    rounds = [(took(word_hashes), took(by_place)) for _ in range(15)]
    ratio = min(x for x, _ in rounds) / min(x for _, x in rounds)
    assert ratio < 0.8


def test_words_end_at_any_white_space():
    """Words are those of str.split(), whatever the white space and the letters beside it; so are their places."""
    import re

    import numpy as np

    from boutlens.llm.substring_dedup import places, seeds

    rng = random.Random(10)
    space = [c for c in map(chr, range(0x3001)) if c.isspace()]
    words = ["".join(rng.choice("ab\x00é¡​‐⁠、﻿中😀") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    odd = "".join(rng.choice(["", *space]) + rng.choice(space) + w for w in words) + rng.choice(["", *space])
    for a, b in (([odd, "", "　", odd + "\xa0x"], [" ".join(words), "", "", " ".join([*words, "x"])]), (["x " * 9], ["x " * 9])):
        for x, y in zip(seeds(a), seeds(b)):
            assert len(x) and np.array_equal(x, y)
    start, stop = places(odd)
    assert list(zip(start.tolist(), stop.tolist())) == [m.span() for m in re.finditer(r"\S+", odd)]
    assert [len(x) for x in places("")] == [0, 0]


def test_units_lie_in_one_document():
    """Units of documents laid end to end are those of each."""
    import numpy as np

    from boutlens.llm.substring_dedup import UNIT, units

    rng = np.random.default_rng(11)
    sizes = [0, 1, UNIT - 1, UNIT, 40, 3, 25]
    parts = [(np.full(n, d), np.cumsum(rng.integers(0, 9, n)), rng.integers(0, 3, n), rng.integers(0, 50, n)) for d, n in enumerate(sizes)]
    each = [(h, i + sum(sizes[:d])) for d, p in enumerate(parts) for h, i in [units(*p)]]
    for got, want in zip(units(*map(np.concatenate, zip(*parts))), map(np.concatenate, zip(*each))):
        assert len(want) and np.array_equal(got, want)


def test_ids_far_apart(spark):
    """First holders are the same whether ids and places fit one number or not."""
    pad = made(12)
    one, two = pad(60), pad(50)
    docs = {0: one + pad(30), 1: pad(20) + one + two, 2: two + pad(10) + one}
    for low, step in ((-3, 2**31 - 1), (-(2**63), 2**62)):
        got = cleaned(spark, {low + step * i: w for i, w in docs.items()})
        first, second = low, low + step
        assert got == {first: [], second: [(20, 80, first)], low + 2 * step: [(0, 50, second), (60, 120, first)]}
