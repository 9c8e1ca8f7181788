"""Hard negatives, fill-in-middle and token counts against brute force, SQL and the library."""

import hashlib
import math
import random

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boutlens.llm import fill_in_middle, hard_negatives, token_counts
from tests.conftest import SF


def vectors(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, kind string").write.parquet(f"{path}/embeddings.parquet")
    return path


def mined(rows):
    """Brute force over Python integers."""
    held = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in v))
        if row not in held:
            held.append(row)
    out = []
    for a in held:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in held if b[0] != a[0])
        for minus, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            fit = [s for s in scored if s[2] != a[1] and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(a[0], positive, rank, b, -minus, -n) for rank, (n, b, _) in enumerate(fit[:3], 1)]
    return sorted(out)


def rows_of(rng, n, dims, hot=0.4):
    rows = []
    for i in range(n):
        v = [round(rng.gauss(0.1, 0.25), 3) for _ in range(dims)]
        rows.append((i, v, 3 if rng.random() < hot else rng.randrange(10), "s", "k"))
    rows += [(i + n, rows[i][1], rows[i + 1][2], "s", "k") for i in range(0, n, 9)]  # equal vectors under other labels: ties
    rows += [(i + 2 * n, rows[50][1], 3, "s", "k") for i in range(60)]  # a group of copies of an anchor
    rows += rows[:20]  # repeated rows
    rows += [(50, rows[7][1], 3, "s", "k"), (None, rows[0][1], 3, "s", "k"), (1000000, None, 3, "s", "k"), (1000050, rows[0][1], None, "s", "k")]
    rows += [(1000100, [float("nan")] * dims, 3, "s", "k"), (1000150, [None] * dims, 3, "s", "k"), (1000200, [math.inf] * dims, 3, "s", "k"), (1000250, [], 3, "s", "k"), (1000300, [0.5], 3, "s", "k")]
    return rows


@pytest.mark.parametrize("dims,block,cell,step", [(8, 2048, 1 << 18, 4096), (16, 3, 40, 7), (3, 1, 1 << 18, 64)])
def test_hard_negatives(spark, monkeypatch, dims, block, cell, step):
    monkeypatch.setattr(hard_negatives, "STEP", step)
    rows = rows_of(random.Random(dims), 150, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, kind string")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(hard_negatives.integer_rows(df, moved), F.col("vec_id") % 50 == 0, block, cell).collect()
    assert sorted(map(tuple, got)) == mined([(r[0], None if r[1] is None else [None if x is None else float(pd.Series([x], dtype="float32")[0]) for x in r[1]], *r[2:]) for r in rows])


def test_hard_negatives_of_wide_components(spark):
    """Scores beyond the exact range of floats, and beyond that of a long."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 18), 1 << 18)) for _ in range(4)], i % 2) for i in range(120)]
    rows += [(200, [float(1 << 18)] * 4, 0), (201, [float((1 << 18) - 1)] * 4, 0)]
    for scale in (1 / 256, 2):
        df = spark.createDataFrame([(i, [x * scale for x in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
        got = hard_negatives.mine(hard_negatives.integer_rows(df, F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")), F.col("vec_id") % 50 == 0).collect()
        assert sorted(map(tuple, got)) == mined([(i, [x * scale for x in v], k) for i, v, k in rows])
    far = df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e4))
    with pytest.raises(ValueError, match="range of a long"):
        hard_negatives.mine(hard_negatives.integer_rows(far, F.col("label")), F.col("vec_id") % 50 == 0)


def test_hard_negatives_of_nothing(spark, tmp_path):
    for name, rows in (("none", []), ("few", [(50, [0.5], 1, "s", "k"), (1, [0.5], 1, "s", "k")])):
        assert hard_negatives.op11_hard_negatives(spark, vectors(spark, rows, str(tmp_path / name))).count() == 0


def filled(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,giant", [(1024, 1 << 20), (2, 0), (6, 30), (64, 200)])
def test_fill_in_middle(spark, chunk, giant):
    rng = random.Random(chunk)
    signs = ["a", "<", "P", "<P", "<S", "M>", "é", "中", "𝄞", " ", "\n", "wort "]
    texts = [None, "", "x", "é", "𝄞", "<P>", "a<S>", "<M", "<<P>", "<P<S", "<X>", "中" * 500, "𝄞é中a" * 300, "ab<M>cd" * 50, "y" * 4097]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "ohne", "k", 1), (None, None, "k", 1), (3, "é", "k", 1), (3, "another", "k", 1), (3, "another", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, place int")
    got = fill_in_middle.transformed(df, chunk, giant, chunk).collect()
    want = [(*filled(i, t)[:5], sha(filled(i, t)[5]), sha(t), filled(i, t)[5]) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_giant_in_pieces(spark):
    """A text of 3 million bytes by the production chunks, beside the same text read in one task."""
    df = spark.createDataFrame([(i, "wörter 中 𝄞 <P x " * 150000) for i in (4, 9)], "doc_id long, text string")
    far = fill_in_middle.transformed(df, full=False).collect()
    near = fill_in_middle.transformed(df, giant=1 << 30, full=False).collect()
    assert sorted(far) == sorted(near) and far[0].n == 150000 * 16 and {r.form for r in far} <= {"psm", "spm"}
    assert all(r.restored_sha256 == sha("wörter 中 𝄞 <P x " * 150000) for r in far)


def test_functions_compose():
    """However a text is cut, the composed functions are those of the whole."""
    import numpy as np

    text = ("<P" + "é中𝄞<S>" * 7 + "x<").encode()
    to, ends = fill_in_middle.functions(*fill_in_middle._chunked([text], 128)[:2])
    for size in (2, 4, 10, 64):
        t, e = fill_in_middle.functions(*fill_in_middle._chunked([text], size)[:2])
        state, ended = fill_in_middle.entries(t, e)
        assert state[-1] == to[0, 0] and ended[-1] == ends[0, 0]
    assert divmod(int(ends[0, 0]), 1 << 40) == (7, len(text.decode())) and isinstance(to, np.ndarray)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.Counter(path), Tokenizer.from_file(path)


PARTS = st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "  ", "\n", "\t ", "\x1c", " ", " ", "'s", "'re", "it's ", "<|endoftext|>", "12 ", "中文", "é", "don't"])), max_size=14)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_token_counts_of_any_text(library, parts):
    counter, tokenizer = library
    text = "".join(parts)
    assert counter.splits and counter.count([text, text]).tolist() == [len(tokenizer.encode(text, add_special_tokens=False))] * 2


def test_token_counts(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CALL", 1000)
    monkeypatch.setattr(token_counts, "MEMO", 50)
    texts = [None, "", "one", "x" * 100000, "wörter und <|endoftext|> mehr\n" * 5000, " ", "1024 " * 1100]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "no id", "k", 1), (2, "one", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    import public_tokenizers

    for name, count in (
        ("byte_bpe_50k.json", lambda t: len(library[1].encode(t, add_special_tokens=False))),
        ("word_bpe_49k.json", None), ("piece_bpe_32k.model", None),
    ):
        path = public_tokenizers.path(name)
        got = token_counts.token_counts(df, path).collect()
        if count is None:
            other = token_counts.Counter(path)
            assert not other.splits
            count = lambda t, other=other: other.lengths([t])[0]
        want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t, *_ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
