"""Each stage of the pipeline against a brute-force version on its own input."""

import corpus_pipeline
import numpy as np
import regex

from boutlens.llm import language_id, packing
from boutlens.llm.common import learnable, read, spool
from boutlens.llm.simhash import similarity
from boutlens.llm.substring_dedup import LEAST_WORDS, SIMILAR, differences
from tests.conftest import SF


def check_language(docs, rows, new):
    """Every text that goes has no letter, or no language that most of its words are in."""
    languages, table = language_id.fit(docs, learnable())
    for r in rows:
        if r.text is None or not regex.search(r"\p{L}", r.text):
            assert r.doc_id not in new
        else:
            top, share = language_id.infer([r.text], table)
            assert (share[0] >= corpus_pipeline.LEAST_SHARE) == (r.doc_id in new)
            if r.doc_id in new:
                assert new[r.doc_id].lang == (r.lang or languages[top[0]]) and new[r.doc_id].text == r.text


def check_passages(held, new):
    """What goes from a text is a passage of LEAST_WORDS or more, alike to one of an earlier document; a long exact one is found."""
    cut = 0
    for i, t in new.items():
        if t != held[i]:
            cut += 1
            assert len(t) < len(held[i])
    assert cut
    # no exact passage of twice the least length that begins a line of an earlier text is left whole
    seen = {}
    for i in sorted(held):
        w = held[i].split()
        for k in range(len(w) - 2 * LEAST_WORDS + 1):
            seen.setdefault(" ".join(w[k : k + 2 * LEAST_WORDS]), i)
    left = whole = 0
    for i, t in new.items():
        w = held[i].split()
        copied = {k for k in range(len(w) - 2 * LEAST_WORDS + 1) if seen[" ".join(w[k : k + 2 * LEAST_WORDS])] < i}
        whole += bool(copied)
        w = t.split()
        left += any(seen.get(" ".join(w[k : k + 2 * LEAST_WORDS]), i) < i for k in range(len(w) - 2 * LEAST_WORDS + 1))
    assert whole and left <= 0.1 * whole
    assert differences(list("abcd"), list("abxd")) == 1 and SIMILAR == 0.8


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        held = {r.doc_id: r.text for r in rows}
        out = spool(stage(spark, docs, SF))
        assert out.columns == columns
        found = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(found)
        new = {i: r.text for i, r in found.items()}
        if name == "language_id":
            check_language(docs, rows, found)
        elif name == "exact_dedup":
            last = {t: i for i, t in sorted(held.items())}
            assert new == {i: t for t, i in last.items()}
        elif name == "simhash_near_dedup":
            for i in held.keys() - new.keys():
                assert max(similarity(held[i], t) for j, t in held.items() if j < i) >= 0.8
            assert all(held[i] == t for i, t in new.items())
        else:
            assert new.keys() == held.keys()
            check_passages(held, new)
        docs = out
    out = corpus_pipeline.packed(spark, docs, SF).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(out.doc_id) == set(texts)
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    whole = {r.doc_id: r.ids for r in packing.encoded(docs).collect()}
    for i, pieces in out.sort_values("start").groupby("doc_id"):
        assert b"".join(pieces.ids) == bytes(whole[i])


def test_exact_stage_judges_rows_by_their_own_text(spark):
    """A doc_id that occurs with two texts loses only the copy; rows repeated in full are one."""
    schema = "doc_id long, text string, __hit string, digest int"
    rows = [(1, "a b c d", "x", 1), (1, "other text", "y", 2), (9, "a b c d", "z", 3), (9, "a b c d", "z", 3), (None, "a b c d", "n", 4), (5, None, "e", 5), (4, "", "f", 6)]
    out = corpus_pipeline.exact(spark, spark.createDataFrame(rows, schema), SF)
    assert out.columns == ["doc_id", "text", "__hit", "digest"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "other text", "y", 2), (9, "a b c d", "z", 3), (None, "a b c d", "n", 4), (5, None, "e", 5)], key=str)


def test_mixed_document(spark):
    """A text half in one language and half in another is given both; its language is one of them."""
    docs = read(spark, SF, "documents")
    languages, table = language_id.fit(docs, learnable())
    by = {}
    for r in docs.filter("lang is not null and length(text) > 500").collect():
        by.setdefault(r.lang, r.text[:500])
    assert len(by) > 1
    a, b = sorted(by)[:2]
    top, share = language_id.infer([by[a], by[a] + " " + by[b]], table)
    assert languages[top[0]] == a and share[0] > 0.9
    assert languages[top[1]] in (a, b) and share[1] < 0.8


def test_long_text_is_walked_in_slices(spark, monkeypatch):
    docs = read(spark, SF, "documents")
    _, table = language_id.fit(docs, learnable())
    texts = [r.text for r in docs.filter("length(text) > 2000").limit(20).collect()]
    want = language_id.infer(texts, table)
    monkeypatch.setattr(language_id, "_CHUNK_BYTES", 300)
    monkeypatch.setattr(language_id, "HELD", 2000)
    got = [language_id.infer([t], table) for t in texts]
    assert [g[0][0] for g in got] == want[0].tolist() and np.allclose([g[1][0] for g in got], want[1], atol=1e-6)


def brute_mixture(text, languages, table):
    """The definition in plain loops: EM with all languages, then with the k most present ones while that pays."""
    words = language_id.words_of(text).split()
    like = []
    for w in words:
        padded = b" " + w + b" "
        own = [sum(float(table[language_id.trigrams(np.frombuffer(padded[i : i + 3], np.uint8))[0], j]) for i in range(len(padded) - 2)) for j in range(len(languages))]
        like.append([np.exp(max(x - max(own), -12)) for x in own])

    def mix(share, rounds):
        for _ in range(rounds):
            sums = [0.0] * len(share)
            for l in like:
                whole = sum(x * s for x, s in zip(l, share))
                sums = [t + x * s / whole for t, x, s in zip(sums, l, share)]
            share = [t / len(like) for t in sums]
        return share, sum(np.log(sum(x * s for x, s in zip(l, share))) for l in like)

    share, _ = mix([1 / len(languages)] * len(languages), 12)
    order = sorted(range(len(languages)), key=lambda j: (-share[j], j))
    best, chosen = -np.inf, share
    for k in range(1, len(languages) + 1):
        kept = [max(share[j], 1e-9) if j in order[:k] else 0 for j in range(len(languages))]
        got, seen = mix([x / sum(kept) for x in kept], 1 if k == 1 else 6)
        if seen - 0.5 * (k - 1) * np.log(len(like) + 1) <= best:
            break
        best, chosen = seen - 0.5 * (k - 1) * np.log(len(like) + 1), got
    top = max(range(len(languages)), key=lambda j: (chosen[j], -j))
    return languages[top], chosen[top]


def test_op9_against_brute_force(spark):
    """The query's predictions, document by document, by a mixture written in loops."""
    docs = read(spark, SF, "documents")
    languages, table = language_id.fit(docs, learnable())
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in language_id.op9_language_id(spark, SF).collect()}
    for i, t in texts.items():
        if language_id.has_letter(t) and len(t) < 4000:
            lang, share = brute_mixture(t, languages, table)
            assert got[i].lang_pred == lang and abs(got[i].score - min(1.0, share)) < 1e-5


def test_any_number_of_languages(spark):
    """Three hundred labels, the rarest of one row: each can be predicted."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26 % 26] + letters[(k * 7 + 3) % 26] + letters[(k * 11 + 5) % 26]
    rows = [(3 * k, " ".join([word(k), word(k)[::-1]] * 30), f"l{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, learnable() | True)
    assert len(model[0]) == 300
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df.drop("lang"), model, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 290


def test_letters_are_category_l(spark):
    rows = [(1, "½"), (2, "²"), (3, "Ⅷ"), (4, "①"), (5, "12 _ 3"), (6, "é"), (7, "字"), (8, None), (9, "")]
    docs = read(spark, SF, "documents")
    out = language_id.predict(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __text string"), language_id.fit(docs, learnable()), ["doc_id", "__text"])
    assert {r.doc_id for r in out.collect() if r.lang_pred != "und"} == {6, 7}


def test_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, removed string, __hit string, __text string"
    empty = spark.createDataFrame([], schema)
    tail = (None, "r", "h", "t")
    rows = [(None, "a b c", None, None, None, 1.0, 2, *tail[1:]), (1, None, None, None, None, None, *tail), (2, "a b c", "en", None, 5, None, 1, *tail[1:]), (2, "a b c", "en", None, 5, None, 1, *tail[1:]), (3, "", "de", "s", 0, None, *tail)]
    for docs, want in ((empty, []), (spark.createDataFrame(rows, schema), [None, 2])):
        for name, stage in corpus_pipeline.STAGES:
            docs = spool(stage(spark, docs, SF))
            if name != "packing":
                assert docs.columns == empty.columns
        assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted(want, key=str)
