"""Byte-level BPE with a segment tree over byte positions.

A piece's leaf i holds the rank of merging the token that starts at byte i with its right neighbour; inner
nodes hold the leftmost minimum of ``FAN`` children. Each merge takes the root, joins two tokens and updates the leaves
of the merged token, the swallowed one and the left neighbour: three logarithmic point updates, each of which ends
at the first node that it leaves as it was. A piece that is a
token itself needs no merging. Pieces are those of the tokenizer's pattern; words that recur are remembered
in a bounded memo of two generations, which changes no result.

Null text is empty text: no ids. Empty texts give no ids, whole texts are encoded however long they are: a long piece's
tree is kept in flat arrays of 64-bit numbers. Repeated rows and rows of null doc_id are encoded like others, an empty
table gives no rows, extra columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = 1 << 62
#: pieces of more bytes are merged in flat arrays
_LONG = 1 << 12
#: children of an inner node
FAN = 16
#: A space after white space; elsewhere a piece always starts at a space, whatever the pattern's other parts.
_GAP = re.compile(r"\s ")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank = len(piece), ranks.get
    held = list if n <= _LONG else functools.partial(array, "q")
    after = held(range(1, n + 2))
    after[n] = n
    before = held(range(-1, n))
    pairs = (rank(piece[i : i + 2]) for i in range(n - 1))
    leaves = held([_NONE if r is None else r * n + i for i, r in enumerate(pairs)])
    leaves.append(_NONE)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append(held([min(below[i : i + FAN]) for i in range(0, len(below), FAN)]))
    top = levels[-1]
    while (best := min(top)) < _NONE:
        i = best % n
        j = after[i]
        k = after[i] = after[j]
        # point updates: the merged token, the swallowed one, the left neighbour
        leaves[i] = leaves[j] = _NONE
        if k < n:
            before[k] = i
            r = rank(piece[i : after[k]])
            if r is not None:
                leaves[i] = r * n + i
        h = before[i]
        if h >= 0:
            r = rank(piece[h:k])
            leaves[h] = _NONE if r is None else r * n + h
        if top is not leaves:
            touched = {i // FAN, j // FAN, max(h, 0) // FAN}
            for below, level in zip(levels, levels[1:]):
                changed = set()
                for t in touched:
                    least = min(below[t * FAN : (t + 1) * FAN])
                    if level[t] != least:
                        level[t] = least
                        changed.add(t // FAN)
                touched = changed
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Memo(dict):
    """Words to packed ids; the older half is forgotten when ``most`` words are held."""

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        # words may be remembered one by one where the pattern begins a piece at every lone space
        self.spaced = self.split("a b 1 ! c") == ["a", " b", " 1", " !", " c"]
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = _Memo(lambda p: _packed(merge(p.encode(), self.ranks)), 200_000)
        self.words = _Memo(lambda w: self._pieces(" " + w))

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.spaced or _GAP.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary) of ``docs`` (doc_id, text): ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of ``encoded`` (doc_id, ids binary)."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            got = [c.decode(t or b"") for t in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode() and decode() of every text in one pass: counts and digests of the ids and of what they decode to."""

    def run(batches):
        c = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                ids = c.encode(text or "")
                rows.append((len(ids) // 4, sha(ids), sha(c.decode(ids))))
            n, ids_sha, decoded_sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
