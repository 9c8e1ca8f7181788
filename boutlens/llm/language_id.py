"""Language ID by multilingual mixture inference.

A model holds, for each learnt language, likelihoods of byte trigrams inside lower-cased words. A document
is a mixture of languages: expectation-maximisation over its words estimates the proportions, first with all
languages, then with only the k most present ones for growing k; the language set is the last one that improved
the likelihood after a penalty of half a log of the word count for each further language.

Every label that has a labelled row to learn from can be predicted: a model takes 128 KB a language in every task. A task
looks at so many words at a time that their likelihoods by all languages stay within ``HELD`` numbers; a text that
has more is walked in slices in every round.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0, and so is everything where
nothing could be learnt (no labelled rows). Whole texts are read; of a very long text a task holds the distinct words
and their counts, and walks them in slices. Ties go to the language that comes first by name. Repeated rows get equal results, an empty table
gives none, and further columns pass through whatever their names. Fitting may use a sample: about ``ROWS_A_LANGUAGE``
labelled rows of each language, chosen by a hash of the id; prediction covers every row.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import free_name, learnable

ROWS_A_LANGUAGE = 1000
#: what is learnt is a table of BINS by languages, gathered to the driver language by language and broadcast
BINS = 1 << 15
#: labels whose counts are broadcast
MOST_LABELS = 100_000
#: bytes of text times languages that a task looks at in one go
HELD = 1 << 25
_PLAIN = re.compile("[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_CHUNK_BYTES = 2 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN.search(text) or _LETTER.search(text)) is not None


def words_of(text: str) -> bytes:
    """Lower-cased words of the text, each with a space on both sides."""
    return b" " + b" ".join(text.lower().encode().translate(_SPACED).split()) + b" "


def trigrams(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint32)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(17)).astype(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if has_letter(text):
                    a = np.frombuffer(words_of(text), np.uint8)
                    inner = a[1:-1] != 32
                    got = seen.setdefault(lang, np.zeros(BINS, np.int64))
                    got += np.bincount(trigrams(a)[inner], minlength=BINS)
        for lang, n in seen.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long")


def fit(docs: DataFrame, may_learn: Column, rows_a_language: int = ROWS_A_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods (trigram bin, language)), from about ``rows_a_language`` rows of each."""
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    # labels are few and small; where they aren't, they meet by a shuffle
    few = sizes.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    some = rows.join(F.broadcast(sizes) if few else sizes, "lang").filter(draw < rows_a_language / F.col("n")).select("lang", "text")
    counts = _counts(some).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages, columns = [], []
    for r in counts.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).orderBy("lang").toLocalIterator():
        column = np.full(BINS, 0.5)
        np.add.at(column, r["gram"], r["n"])
        languages.append(r["lang"])
        columns.append(np.log(column / column.sum()).astype(np.float32))
    return languages, np.stack(columns, axis=1) if columns else np.zeros((BINS, 0), np.float32)


def _mix(like: np.ndarray, weight: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over the weighted words of many documents at once: proportions and log likelihood of each document."""
    doc = np.repeat(np.arange(len(n)), n)
    total = np.add.reduceat(weight, starts)
    for _ in range(rounds):
        part = like * share[doc]
        part *= (weight / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    seen = np.log((like * share[doc]).sum(axis=1)) * weight
    return share, np.add.reduceat(seen, starts)


def _distinct(text: str) -> Counter:
    """The distinct words of a very long text, walked in slices, and their counts."""
    seen: Counter = Counter()
    lo = 0
    while lo < len(text):
        hi = text.find(" ", lo + _CHUNK_BYTES) if lo + _CHUNK_BYTES < len(text) else len(text)
        hi = len(text) if hi < 0 else hi
        seen.update(words_of(text[lo:hi]).split())
        lo = hi
    return seen


def _likelihoods(a: np.ndarray, last: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word begins, its likelihood by each language) of words with a space on both sides; ``last`` marks the
    spaces that end a text."""
    logs = table[trigrams(np.concatenate([a, np.zeros(2, np.uint8)]))]
    space = a == 32
    logs[np.append(space[1:], True)] = 0
    words = np.nonzero(space & ~last)[0]
    like = np.add.reduceat(logs, words, axis=0).astype(np.float64)
    return words, np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -12))


def _chosen(mix, total: np.ndarray, texts: int, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(best language, its proportion) of each text, by ``mix(share, rounds)``: the set of languages by penalised likelihood."""
    share, _ = mix(np.full((texts, languages), 1 / languages), 12)
    order = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, best_share, open_ = np.full(texts, -np.inf), share, np.ones(texts, bool)
    for k in range(1, languages + 1):
        kept = np.where(order < k, np.maximum(share, 1e-9), 0)
        got, seen = mix(kept / kept.sum(axis=1, keepdims=True), 1 if k == 1 else 6)
        value = seen - 0.5 * (k - 1) * np.log(total + 1)
        open_ &= value > best
        if not open_.any():
            break
        best_share = np.where(open_[:, None], got, best_share)
        best = np.where(open_, value, best)
    top = best_share.argmax(axis=1)
    return top, best_share[np.arange(texts), top]


def _long(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """infer() of one text whose likelihoods aren't held: every round walks its distinct words in slices."""
    seen = _distinct(text)
    slices, held, size = [], [], 0
    for word in seen:
        if held and (size + len(word)) * table.shape[1] > HELD:
            slices.append(held)
            held, size = [], 0
        held.append(word)
        size += len(word) + 1
    slices.append(held)

    def mix(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for n in range(rounds + 1):
            parts, value = np.zeros(table.shape[1]), 0.0
            for words in slices:
                a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
                weight = np.array([seen[w] for w in words], float)
                last = np.zeros(len(a), bool)
                last[-1] = True
                part = _likelihoods(a, last, table)[1] * share[0]
                whole = part.sum(axis=1)
                value += float(np.log(whole) @ weight)
                parts += (weight / whole) @ part
            if n < rounds:
                share = (parts / seen.total())[None, :]
        return share, np.array([value])

    return _chosen(mix, np.array([float(seen.total())]), 1, table.shape[1])


def infer(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, its proportion) of texts that have letters."""
    if len(texts) == 1 and len(texts[0]) * table.shape[1] > HELD:
        return _long(texts[0], table)
    # a text whose letters are all single words still has two spaces around each
    blobs = [words_of(t) for t in texts]
    a = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.cumsum([len(b) for b in blobs])
    last = np.zeros(len(a), bool)
    last[ends - 1] = True
    words, like = _likelihoods(a, last, table)
    n = np.bincount(np.searchsorted(ends, words, side="right"), minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    return _chosen(lambda share, rounds: _mix(like, np.ones(len(words)), starts, n, share, rounds), n.astype(float), len(texts), table.shape[1])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with the prediction and its score under ``names``; text is read from ``docs.text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]
    text = free_name(docs, "__text")

    def run(batches):
        languages, table = shared.value
        most = min(_CHUNK_BYTES, HELD // max(1, len(languages)))
        for b in batches:
            texts = b.column(text).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if languages and has_letter(t)]
            lo = 0
            while lo < len(todo):
                hi, size = lo, 0
                while hi < len(todo) and (hi == lo or size + len(texts[todo[hi]]) < most):
                    size += len(texts[todo[hi]])
                    hi += 1
                top, share = infer([texts[i] for i in todo[lo:hi]], table)
                for i, t, s in zip(todo[lo:hi], top.tolist(), share.tolist()):
                    pred[i], score[i] = languages[t], min(1.0, max(0.0, s))
                lo = hi
            own = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in fields), *names])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.select(*(f.name for f in fields), F.col("text").cast("string").alias(text)).mapInArrow(run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs, learnable()), ["doc_id"])
    return out.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
