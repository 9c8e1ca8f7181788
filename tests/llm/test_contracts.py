"""The contract queries over the smallest tables, against brute force."""

import base64
import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from boutlens.llm import byte_bpe, exact_dedup
from boutlens.llm import queries as registry
from tests.conftest import SF

EDGE = pd.DataFrame(
    {
        "doc_id": pd.array([1, 2, 3, 4, 5, 6, 7], "Int64"),
        "text": [None, "", "a b", "a b", "A  B", "wörter und, 12\n\n x" * 3, "long " * 30000],
        "lang": [None, "en", "en", None, "de", "de", "en"],
        "source": [None] * 6 + ["s"], "key": ["k"] * 7, "node": [1] * 7, "digest": ["d"] * 7,
    }
)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").df()


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("edge"))
    schema = "doc_id long, text string, lang string, source string, key string, node long, digest string"
    rows = [[None if v is pd.NA else v for v in r] for r in EDGE.astype(object).where(EDGE.notna(), None).values.tolist()]
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/documents.parquet")
    return base


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").filter("false").write.parquet(f"{base}/{t}.parquet")
    return base


def simhash_brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op1(spark, docs, edge_dir, where):
    rows = docs if where == "sf" else EDGE
    got = registry.queries()["op1_simhash"](spark, SF if where == "sf" else edge_dir).toPandas().set_index("doc_id")
    fp = {int(i): simhash_brute(t) for i, t in zip(rows.doc_id, rows.text)}
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if comp[j] < comp[i] and (fp[i] ^ fp[j]).bit_count() <= 3:
                    comp[i], changed = comp[j], True
    assert got.fingerprint.to_dict() == {i: f"{f:016x}" for i, f in fp.items()}
    assert got.component_id.to_dict() == comp


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op3(spark, docs, edge_dir, where):
    import tiktoken

    rows = docs if where == "sf" else EDGE
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = registry.queries()["op3_byte_bpe"](spark, SF if where == "sf" else edge_dir).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, t in zip(rows.doc_id, rows.text):
        ids = enc.encode_ordinary(t or "")
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest()


def test_op3_long_pieces_and_other_patterns():
    """Flat arrays merge as lists do; a pattern that doesn't begin pieces at spaces is split as a whole."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    for piece in ("ab" * 6000, "x" * 5000 + "yz" * 900, "é" * 5000):
        assert len(piece.encode()) > byte_bpe._LONG
        long = byte_bpe.merge(piece.encode(), c.ranks)
        enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=c.ranks, special_tokens={})
        assert long == enc.encode_ordinary(piece)
    other = byte_bpe.Codec(path, r"(?s).{1,7}")
    assert c.spaced and not other.spaced
    want = tiktoken.Encoding("own", pat_str=r"(?s).{1,7}", mergeable_ranks=c.ranks, special_tokens={}).encode_ordinary("some words in a row")
    assert np.frombuffer(other.encode("some words in a row"), "<u4").tolist() == want


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op6(spark, edge_dir, where):
    base = SF if where == "sf" else edge_dir
    got = registry.queries()["op6_exact_dedup"](spark, base).toPandas().sort_values("doc_id").reset_index(drop=True)
    path = f"{base}/documents.parquet" + ("" if where == "sf" else "/*.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    want = con.sql(registry.oracle_sql()["op6_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_op6_unequal_texts_under_one_digest(spark):
    """A digest of three values: texts are told apart by their bytes all the same."""
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda t: F.unhex(F.sha2((F.length(t) + F.ascii(F.right(t, F.lit(1))) % 3).cast("string"), 256))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(df, exact_dedup.half_is_new(), digest).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    assert got == {i: (max(v), len(v), i == max(v)) for v in by.values() for i in v}


def test_op6_kept_filters(spark, tmp_path):
    """A snapshot's filters, written once, screen a batch as filters built on the way do."""
    rows = [(i, f"t{i % 50}", i >= 70) for i in range(100)] + [(200, "only new", True), (201, "only old", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fresh boolean")
    exact_dedup.write_filters(df.filter("not fresh"), str(tmp_path / "f"))
    one, two = ({r.doc_id: tuple(r) for r in exact_dedup.dedup(df, F.col("fresh"), filters=f).collect()} for f in (None, str(tmp_path / "f")))
    assert one == two and one[20][1] == 70 and one[200][3]


def test_op9(spark, docs, edge_dir):
    got = registry.queries()["op9_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    known = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (known.lang_pred == known.lang).mean() > 0.9
    assert got.score.between(0, 1).all()
    edge = registry.queries()["op9_language_id"](spark, edge_dir).toPandas().set_index("doc_id")
    assert edge.lang_pred[1] == edge.lang_pred[2] == "und"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty(spark, empty_dir, name):
    out = registry.queries()[name](spark, empty_dir).collect()
    assert [r for r in out if r[0] != -7] == []
