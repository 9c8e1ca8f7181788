"""op2, op5 and op7 against brute force."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash

from boutlens.llm import chat, imatch, packing
from boutlens.llm import queries as registry
from tests.conftest import SF
from tests.llm.test_contracts import EDGE, docs, edge_dir  # noqa: F401


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check_chat(got, convs):
    assert len(got) == len(convs)
    for c, turns in convs.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        row = got.loc[c]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), sha(learnt))
        assert row.formatted_chars == sum(len(chat.formatted(r, t)[0]) for r, t in turns)


def test_op2(spark):
    convs = {chat.PROBE[0]: chat.PROBE[1]}
    for c, _, r, t in duckdb.sql(f"select * from '{SF}/conversations.parquet' order by conv_id, turn").fetchall():
        convs.setdefault(c, []).append((r or "", t or ""))
    check_chat(registry.queries()["op2_chat_tree"](spark, SF).toPandas().set_index("conv_id"), convs)


def test_op2_shared_and_odd(spark, tmp_path):
    convs = {i: [("system", "same"), ("user", f"q{i % 5} \\ </turn> ###"), ("assistant", "a" * (i % 7)), ("a:b\n### x", "z")] for i in range(60)}
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows.append((99, 0, None, None, None))
    convs[99] = [("", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    convs[chat.PROBE[0]] = chat.PROBE[1]
    check_chat(registry.queries()["op2_chat_tree"](spark, str(tmp_path)).toPandas().set_index("conv_id"), convs)
    blocks = chat.pack_tree(df).toPandas()
    assert blocks.text.str.count("same").sum() <= blocks.block.nunique()
    check_blocks(blocks, convs)


def check_blocks(blocks, convs):
    """Every added token's position and what it attends to, against the conversation written out by itself."""
    for _, block in blocks.groupby("block"):
        block = block.sort_values("start", kind="stable")
        whole = "".join(block.text)
        for row in block.itertuples():
            if row.conv_id == chat.PROBE[0]:
                continue
            parts = [chat.formatted(r, t)[0] for r, t in convs[row.conv_id]]
            shared = len(row.ancestors)
            assert [whole[s["start"] : s["stop"]] for s in row.ancestors] == parts[:shared]
            assert [whole[s["start"] : s["stop"]] for s in row.own] == parts[shared:] and row.text == "".join(parts[shared:])
            assert row.position == len("".join(parts[:shared]))
            assert whole[row.start : row.start + len(row.text)] == row.text


def test_op2_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "n"), (None, 1, "assistant", "m" * 100000), (2, None, "user", "first"), (2, 0, "assistant", "x")]
    convs = {1: [("user", "a")] * 2, 2: [("user", "first"), ("assistant", "x")]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.queries()["op2_chat_tree"](spark, str(tmp_path)).toPandas()
    assert got.conv_id.isna().sum() == 1 and len(got) == 4
    got = got.dropna(subset="conv_id").set_index("conv_id")
    check_chat(got, convs | {chat.PROBE[0]: chat.PROBE[1]})


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op5(spark, docs, edge_dir, where):  # noqa: F811
    rows = docs if where == "sf" else EDGE
    got = registry.queries()["op5_imatch"](spark, SF if where == "sf" else edge_dir).toPandas().set_index("doc_id")
    texts = dict(zip(map(int, rows.doc_id), (t or "" for t in rows.text)))
    order = sorted(texts, reverse=True)
    prints = {}
    for i, j in zip(order, order[1:] + order[:1]):
        t, k = texts[i], len(texts[i]) // 3
        assert got.n_chars[i] == len(t)
        assert got.edited_sha256[i] == sha(t[: len(t) - k] + texts[j][:k])
        assert prints.setdefault(t, got.fingerprint[i]) == got.fingerprint[i]
        if t == texts[j]:
            assert got.near_next[i] == 1
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    if where == "sf":
        print(got[["near_edited", "near_next"]].describe())
        assert (got.near_edited > got.near_next).mean() > 0.9


def spark_long(value, seed=42):
    h = xxhash.xxh64(struct.pack("<q", value), seed=seed % (1 << 64)).intdigest()
    return h - (1 << 64) if h >> 63 else h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprint_brute(texts):
    """The fingerprints as hexadecimal text, from the definition: lexicon by exact counts, subsets, hashes."""
    words = {t: sorted({signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}) for t in set(texts)}
    df = Counter(w for t in texts for w in words[t])
    n = len(texts)
    bits = {w % imatch.BITS for w, k in df.items() if imatch.LOWEST_SHARE * n <= k <= max(imatch.HIGHEST_SHARE * n, 1)}
    out = {}
    for t, own in words.items():
        kept = [w for w in own if w % imatch.BITS in bits] or own or [signed(xxhash.xxh64(t.encode(), seed=42).intdigest())]
        parts = []
        for g in range(imatch.SCALES):
            if g:
                kept = [w for w in kept if (w % (1 << 64)) >> (40 + 2 * g) & 3 == 0]
            for k in range(imatch.SUBSETS):
                h, some = 42, [w for w in kept if ((w % (1 << 64)) >> (23 + g)) % imatch.SUBSETS == k]
                for w in some:
                    h = spark_long(w, h)
                parts.append(f"{h & 0xFFFFFFFF:08x}" if some else "00000000")
        out[t] = "".join(parts)
    return out


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op5_fingerprints(spark, docs, edge_dir, where):  # noqa: F811
    rows = docs if where == "sf" else EDGE
    got = registry.queries()["op5_imatch"](spark, SF if where == "sf" else edge_dir).toPandas().set_index("doc_id")
    texts = [t or "" for t in rows.text]
    want = fingerprint_brute(texts)
    assert got.fingerprint.to_dict() == {int(i): want[t] for i, t in zip(rows.doc_id, texts)}


def test_op5_ranges(spark, monkeypatch):
    """Neighbours across many ranges of doc_id, with ids repeated and missing."""
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 7)
    ids = [i * 3 for i in range(100)]
    df = spark.createDataFrame([(i, f"text {i} " * 3, "p") for i in ids] + [(None, "none", "p")], "doc_id long, text string, place string")
    got = {r.doc_id: r.next for r in imatch.beside_next(df.select("doc_id", "text"), ["text"]).collect()}
    assert len(got) == 101 and got[None] is None
    assert all(got[i].text == f"text {j} " * 3 for i, j in zip(ids[1:] + ids[:1], ids))


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op7(spark, docs, edge_dir, where):  # noqa: F811
    from tokenizers import Tokenizer

    rows = docs if where == "sf" else EDGE
    got = registry.queries()["op7_packing"](spark, SF if where == "sf" else edge_dir).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = dict(list(got.sort_values("start").groupby("doc_id")))
    for i, text in zip(rows.doc_id, rows.text):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in pieces[i].itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 1024 and s.length.sum().bit_count() == 1


def test_op7_added_tokens(spark):
    """Ids of texts that hold the added token, against the library as it is shipped."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endoftext|>", "<|endoftext", "plain"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        assert np.frombuffer(got.ids[i], "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_hilbert_is_a_walk():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
