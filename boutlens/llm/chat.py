r"""Chat formatting over a prefix tree.

A turn is ``### role: text </turn>`` and a line feed; inside roles and texts a backslash goes before each
backslash, ``###``, ``</turn>`` and, in roles, colon, so that what has no backslash is always a control string.
Conversations are range-sorted by the chain of their turns' hashes, which is the depth-first order of their
prefix tree; whether two of them share a turn is decided by its role and text. Each task writes one block: a
conversation adds only the turns that it doesn't share with the one before it, so every shared turn is written once; a
block starts its own tree, so a tree that holds a third of all rows spreads over tasks and only the one path at each
cut is written again. A turn's tokens (code points) get position ids from the start of their conversation and attend
to their own turn and to the intervals of their ancestors in the block.

Null roles and texts are empty; turns of equal number are ordered by role and text, repeated rows are turns of their
own; null turn numbers come first; rows of null conv_id are one conversation. A task holds one conversation and the
path before it, whole, however long. An empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import spool

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)
PROBE = (-7, [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")])


def escape(text: str, what=_IN_TEXT) -> str:
    return what.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text and the bounds of what the loss covers: an assistant's words."""
    head = OPEN + escape(role, _IN_ROLE) + COLON
    body = escape(text)
    learnt = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + CLOSE, *learnt


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn starts at {at}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def _conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: (conv_id, path, roles, texts); path chains 8 bytes of hash a turn."""

    def run(batches):
        conv, roles, texts, done, size = None, [], [], [], 0

        def close():
            path, link = b"", b""
            for r, t in zip(roles, texts):
                link = hashlib.sha256(link + r.encode() + b"\n" + t.encode()).digest()
                path += link[:8]
            done.append((conv, path, roles, texts))
            return sum(map(len, texts))

        def table():
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv_id", "path", "roles", "texts"])

        for b in batches:
            for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if roles and c != conv:
                    size += close()
                    roles, texts = [], []
                    if len(done) >= 1000 or size >= 1 << 22:
                        yield table()
                        done, size = [], 0
                conv = c
                roles.append(r)
                texts.append(t)
        if roles:
            close()
        if done:
            yield table()

    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, path binary, roles array<string>, texts array<string>")


_SPAN = "array<struct<start:long,stop:long>>"
_OUT = f"block long, conv_id long, start long, text string, position long, ancestors {_SPAN}, own {_SPAN}, loss {_SPAN}"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def pack_tree(rows: DataFrame) -> DataFrame:
    """The blocks, a row for each conversation in depth-first order.

    ``text`` is what the conversation adds at offset ``start`` of its block, its first token's position id
    is ``position`` and the following ones count up; ``ancestors`` are the block intervals of the turns shared
    with earlier conversations, to which the added tokens attend; ``own`` are the intervals of the added turns;
    ``loss`` are the intervals of the whole conversation that the loss covers, shared ones included.
    """

    def run(batches):
        block = TaskContext.get().partitionId()
        path, said, turns, end = b"", [], [], 0  # turns: (start, stop, loss start, loss stop) of the live path
        for b in batches:
            out = []
            for conv, key, roles, texts in zip(*(b.column(x).to_pylist() for x in ("conv_id", "path", "roles", "texts"))):
                shared, own = 0, list(zip(roles, texts))
                while shared < min(len(own), len(said)) and key[8 * shared : 8 * shared + 8] == path[8 * shared : 8 * shared + 8] and own[shared] == said[shared]:
                    shared += 1
                path, said, turns = key, own, turns[:shared]
                begin, added = end, []
                for r, t in zip(roles[shared:], texts[shared:]):
                    s, lo, hi = formatted(r, t)
                    turns.append((end, end + len(s), end + lo, end + hi))
                    added.append(s)
                    end += len(s)
                span = lambda x, y: {"start": x, "stop": y}
                out.append((
                    block, conv, begin, "".join(added), sum(y - x for x, y, _, _ in turns[:shared]),
                    [span(x, y) for x, y, _, _ in turns[:shared]], [span(x, y) for x, y, _, _ in turns[shared:]],
                    [span(x, y) for _, _, x, y in turns if y > x],
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _SPANS, _SPANS, _SPANS]
            names = ["block", "conv_id", "start", "text", "position", "ancestors", "own", "loss"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return spool(_conversations(rows)).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, _OUT)


def read_back(blocks: DataFrame) -> DataFrame:
    """Each conversation, read from its block's text by its intervals alone: (conv_id, text, learnt)."""

    def run(batches):
        pieces, block = [], None  # (start, stop, text) of the live path
        for b in batches:
            out = []
            cols = ("block", "conv_id", "start", "text", "ancestors", "own", "loss")
            for at, conv, start, text, ancestors, own, loss in zip(*(b.column(x).to_pylist() for x in cols)):
                if at != block:
                    pieces, block = [], at
                pieces = pieces[: len(ancestors)]
                if [(p[0], p[1]) for p in pieces] != [(s["start"], s["stop"]) for s in ancestors]:
                    raise ValueError("an ancestor's interval isn't on the path before it")
                pieces += [(s["start"], s["stop"], text[s["start"] - start : s["stop"] - start]) for s in own]
                learnt, i = [], 0
                for s in loss:
                    while pieces[i][1] < s["stop"]:
                        i += 1
                    lo = pieces[i][0]
                    learnt.append(unescape(pieces[i][2][s["start"] - lo : s["stop"] - lo]))
                out.append((conv, "".join(p[2] for p in pieces), "".join(learnt)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.string(), pa.string()])], ["conv_id", "text", "learnt"])

    return blocks.mapInArrow(run, "conv_id long, text string, learnt string")


def op2_chat_tree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE[0], i, r, t) for i, (r, t) in enumerate(PROBE[1])], "conv_id long, turn long, role string, text string")

    def digest(batches):
        for b in batches:
            out = []
            for conv, text, learnt in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "learnt"))):
                turns = parse(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((conv, len(turns), sha(whole), len(learnt), sha(learnt), len(text)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return read_back(pack_tree(rows.unionByName(probe))).mapInArrow(digest, schema)
