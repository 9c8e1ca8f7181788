"""Token counts: lengths of batch encodings, never the ids.

In each Arrow batch texts are split at safe boundaries, where no token of the tokenizer's pattern can lie across: before
white space that follows something else. The pieces that aren't remembered are encoded once each, by the tokenizer's own
library, in calls of about ``CALL`` bytes, and a text's count is the sum over its pieces. So a call's work follows
bytes, not rows, and a long text is held in pieces. Counts of short pieces are remembered in a bounded memo, which
changes no result. Boundaries are only used where the tokenizer's file says that they are safe (byte-level pieces by the
usual pattern, no normaliser, no prefix, added tokens without white space); any other tokenizer gets whole texts.

Null text counts as empty: no bytes, no tokens. Texts are counted whole however long; a run without white space is one
piece. Repeated rows and rows of null doc_id give a row each, an empty table none; extra columns are ignored whatever
their names.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import read

LIMIT = 1024
#: bytes of one call of the library, pieces that are remembered, characters of a piece worth remembering
CALL, MEMO, SHORT = 1 << 20, 500_000, 48
#: what lies between two safe boundaries
_PIECE = re.compile(r"\s*\S+|\s+")


class Counter:
    """Counts tokens as the library of the file at ``path`` does: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.splits, self.memo = False, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path) as f:
            made = json.load(f)
        first = made["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not made["normalizer"]
        self.splits = plain and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])

    def _encode(self, pieces: list[str]) -> list[int]:
        """Lengths of ``pieces``, in calls of about ``CALL`` bytes; a longer piece is a call of its own."""
        out, held, size = [], [], 0
        for piece in pieces:
            if held and size + 4 * len(piece) > CALL:
                out += self.lengths(held)
                held, size = [], 0
            held.append(piece)
            size += 4 * len(piece)
        return out + self.lengths(held) if held else out

    def count(self, texts: list[str]) -> np.ndarray:
        if not self.splits:
            return np.array(self._encode(texts), np.int64)
        out, memo = np.zeros(len(texts), np.int64), self.memo
        waiting: dict[str, list[int]] = {}
        size = 0

        def settle() -> None:
            for (piece, rows), n in zip(waiting.items(), self._encode(list(waiting))):
                np.add.at(out, rows, n)
                if len(piece) <= SHORT:
                    memo[piece] = n
            waiting.clear()

        for i, text in enumerate(texts):
            pieces = _PIECE.findall(text)
            try:
                out[i] = sum(map(memo.__getitem__, pieces))
                continue
            except KeyError:
                pass
            for piece in pieces:
                n = memo.get(piece)
                if n is not None:
                    out[i] += n
                else:
                    if piece not in waiting:
                        waiting[piece] = []
                        size += 4 * len(piece)
                    waiting[piece].append(i)
            if size > CALL:
                settle()
                size = 0
        settle()
        if len(memo) > MEMO:
            memo.clear()
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text) by the tokenizer file at ``path``."""

    def run(batches):
        for b in batches:
            n = counter(path).count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
