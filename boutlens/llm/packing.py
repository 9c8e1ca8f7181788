"""Packing along a space-filling curve.

A document's words are hashed to a signed vector, projected to ``DIMS`` dimensions by a fixed random matrix
and quantised; its Hilbert index is the sort key. Documents are range-sorted by it and packed in that order:
each task fills its sequences to the brim, cutting documents freely, and cuts what is left over at the end
into sequences whose lengths are powers of two, which need no padding. Documents are dealt out in blocks of at most
``BLOCK`` ids, so that ranges of as many rows are of like size, however long some documents are. Equal texts have equal
keys; ties are ordered by doc_id and place, so that even a third of all rows under one key spreads over tasks.

Added tokens of the tokenizer (``<|endoftext|>``) are found in texts and give their own ids, as the tokenizers
library has it. Null text is empty text: its only id is the closing 0. Rows of null doc_id are packed like others, and
so are repeated rows, one by one. Long documents span many sequences. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import spool

DIMS, BITS, BINS, LENGTH, END = 4, 12, 512, 1024, 0
BLOCK = 2048


@functools.cache
def _encoder(ranks_path: str, json_path: str):
    """Texts to ids: the ranks of the vocabulary, and the added tokens that the tokenizer's file names."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path) as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    codec = tiktoken.Encoding(json_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in added.values()}, special_tokens=added)

    def encode(text: str) -> list[int]:
        return codec.encode(text, allowed_special="all") if any(t in text for t in added) else codec.encode_ordinary(text)

    return encode


@functools.cache
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BINS, DIMS))


def vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Hashed count vectors of token ids, projected and squeezed to (0, 1)."""
    out = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        h = (x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        v = np.sqrt(np.bincount(h % BINS, minlength=BINS))
        norm = np.linalg.norm(v)
        out[i] = v @ _projection() / norm if norm else 0
    return 1 / (1 + np.exp(-2 * out))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer ``points`` (row, dimension) below 2**bits, by Gray-code rotations of the axes."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for d in range(dims):
            set_ = (x[d] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level) & 1
    return key


def tokens(docs: DataFrame, ranks_path: str, json_path: str) -> DataFrame:
    """(doc_id, curve, ids) of ``docs``: the Hilbert key and the closed ids as little-endian 32-bit integers.

    The ids are those of the tokenizers library for ``json_path``, taken from the ranks of the same vocabulary,
    ``ranks_path``, which is three times as fast.
    """

    def run(batches):
        encode = _encoder(ranks_path, json_path)
        for b in batches:
            ids = [np.array(encode(text), "<u4") for text in b.column("text").to_pylist()]
            curve = hilbert((vectors(ids) * (1 << BITS)).astype(np.int64)) if ids else []
            closed = [np.append(x, np.uint32(END)).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(curve, pa.int64()), pa.array(closed, pa.binary())], ["doc_id", "curve", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, curve long, ids binary")


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(encoded: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of the ``encoded`` documents along the curve: where each run of a document's ids lies."""

    names = [f.split()[0] for f in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        seq, used, open_ = 0, 0, []

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            done = []
            for doc, start, total, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "total", "ids"))):
                at = 0
                while 4 * at < len(raw):
                    n = min(len(raw) // 4 - at, length - used)
                    ids = raw[4 * at : 4 * (at + n)]
                    last = open_[-1] if open_ else None
                    if last and last[0] == doc and last[1] + last[2] == start + at:  # a block goes on where the one before it ends
                        open_[-1] = (doc, last[1], last[2] + n, last[3] + ids, total, *last[5:])
                    else:
                        open_.append((doc, start + at, n, ids, total, base + seq, used))
                    at, used = at + n, used + n
                    if used == length:
                        done += open_
                        seq, used, open_ = seq + 1, 0, []
            if done:
                yield table(done)
        # what is left: full powers of two, the largest first
        rows, room, used = [], 0, sum(p[2] for p in open_)
        offset = 0
        for doc, at, n, raw, total, _, _ in open_:
            cut = 0
            while cut < n:
                if not room:
                    room, offset = 1 << (used.bit_length() - 1), 0
                    used -= room
                    seq += 1
                m = min(n - cut, room)
                rows.append((doc, at + cut, m, raw[4 * cut : 4 * (cut + m)], total, base + seq, offset))
                cut, room, offset = cut + m, room - m, offset + m
        if rows:
            yield table(rows)

    total = F.floor(F.length("ids") / 4)
    starts = encoded.select("doc_id", "curve", "ids", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(BLOCK).cast("long"))).alias("start"))
    block = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), F.lit(4 * BLOCK))
    order = ["curve", "doc_id", "start"]
    return starts.select("doc_id", "curve", "start", "total", block.alias("ids")).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECES)


def encoded(docs: DataFrame) -> DataFrame:
    """tokens() by the public vocabulary of 50,257 entries."""
    import public_tokenizers

    return tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(spool(encoded(docs)))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
