"""Fill-in-the-middle transformation by a parallel automaton scan.

A deterministic automaton reads the UTF-8 bytes of a text; its states are how many bytes a code point still lacks and how
much of a mark (``<P>``, ``<S>``, ``<M>``) has been read. Bytes are cut into chunks of equal size anywhere, also inside
code points and marks. A chunk, not knowing the state it is entered in, gives its transition function: for every state
the one it is left in, and how many code points and marks end meanwhile. Functions compose associatively: pairs of
bytes, of words and of chunks are composed alike, and composing the chunks of a document in order tells the state that
each is really entered in, how many code points lie before it, the length of the text and whether it holds a mark. Then
a cut after so many code points is looked for only in the chunk that it falls into.

Texts of up to ``GIANT`` bytes are read where they lie, all chunks of a batch at once, without a shuffle. The chunks of
longer ones are written once and dealt out over all tasks; only their functions (some 60 bytes a chunk) come together by document, the
chunks that cuts fall into are met again by key, and the plan is joined to the text. Both ways use the same functions
and give the same results.

Null text counts as empty, and an empty text is plain. Texts are read whole. The hash of a null doc_id is that of ``1:``
alone. Rows repeated in doc_id and text give a row each, with equal results; rows that share a doc_id are judged by
their own texts. An empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import read, spool

MARKS = ("<P>", "<S>", "<M>")
#: bytes of a chunk, of the longest text that is read in one task, and of a chunk of longer ones
CHUNK, GIANT, GIANT_CHUNK = 1 << 10, 1 << 20, 1 << 14
#: shares in percent: plain texts, and of the others those with the suffix first
PLAIN, SUFFIX_FIRST = 10, 20
# states: 0 to 3 between code points, having read nothing of a mark, "<", or "<" and a letter; 3 to 5 lacking 1 to 3 bytes
_STATES, _LACKING = 6, 2
#: a count of code points and one of marks in one number
_MARK = 1 << 40


@functools.cache
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """The automaton: for each byte and state the next state, and the code points and marks that the byte ends."""
    to, ends = np.zeros((256, _STATES), np.uint8), np.zeros((256, _STATES), np.int64)
    letters = {ord(m[1]) for m in MARKS}
    for byte in range(256):
        for state in range(_STATES):
            if byte < 0x80:
                to[byte, state] = 1 if byte == ord("<") else 2 if state == 1 and byte in letters else 0
                ends[byte, state] = 1 + (_MARK if state == 2 and byte == ord(">") else 0)
            elif byte < 0xC0:  # a further byte: it ends a code point that lacks one
                to[byte, state] = state - 1 if state > _LACKING + 1 else 0
                ends[byte, state] = state == _LACKING + 1
            else:
                to[byte, state] = _LACKING + (1 if byte < 0xE0 else 2 if byte < 0xF0 else 3)
    return to, ends


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of functions (next state, what ends, by state), each followed by another."""
    (to, ends), (to2, ends2) = first, then
    return np.take_along_axis(to2, to.astype(np.intp), axis=1), ends + np.take_along_axis(ends2, to.astype(np.intp), axis=1)


@functools.cache
def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """The functions of all pairs of bytes, the first byte the lower half of the number."""
    to, ends = _steps()
    low, high = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    return compose((to[low], ends[low]), (to[high], ends[high]))


def _identity(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.arange(_STATES, dtype=np.uint8), (n, 1)), np.zeros((n, _STATES), np.int64)


def functions(chunks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions of ``chunks`` (rows of an even number of bytes), of whose bytes the first ``sizes`` count.

    Neighbours are composed level by level: pairs of bytes come from a table, then pairs of pairs and so on.
    """
    words = np.ascontiguousarray(chunks).view("<u2")
    to, ends = (t[words.ravel()] for t in _pairs())
    n, width = words.shape
    # what lies behind a chunk's end changes nothing
    at = 2 * np.arange(width)
    behind = (at[None, :] >= sizes[:, None]).ravel()
    to[behind], ends[behind] = np.arange(_STATES), 0
    odd = np.flatnonzero(sizes % 2)
    last = odd * width + sizes[odd] // 2
    one = chunks[odd, sizes[odd] - 1]
    to[last], ends[last] = _steps()[0][one], _steps()[1][one]
    while width > 1:
        if width % 2:
            more, none = _identity(n)
            to = np.concatenate([to.reshape(n, width, -1), more[:, None]], axis=1).reshape(-1, _STATES)
            ends = np.concatenate([ends.reshape(n, width, -1), none[:, None]], axis=1).reshape(-1, _STATES)
            width += 1
        to, ends = compose((to[::2], ends[::2]), (to[1::2], ends[1::2]))
        width //= 2
    return to, ends


def entries(to: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the chunks of one text in order: the state that each is entered in, and what ends before it (one more: at the end)."""
    span = 1
    done_to, done_ends = to.copy(), ends.copy()  # prefixes by doubling: each chunk composed with all before it
    while span < len(to):
        joined = compose((done_to[:-span], done_ends[:-span]), (done_to[span:], done_ends[span:]))
        done_to[span:], done_ends[span:] = joined
        span *= 2
    return np.r_[0, done_to[:, 0]], np.r_[0, done_ends[:, 0]]


def place(chunk: bytes, state: int, points: int) -> int:
    """The bytes of ``chunk``, entered in ``state``, up to the end of its ``points``-th code point."""
    if points <= 0:
        return 0
    b = np.frombuffer(chunk, np.uint8)
    lacking = max(0, int(state) - _LACKING)
    # code points that begin here end before the next beginning; the one that the chunk is entered in ends first
    starts = np.flatnonzero((b & 0xC0) != 0x80)
    starts = starts[starts >= lacking]
    whole = points - (lacking > 0)
    return int(starts[whole]) if whole < len(starts) else len(b)


def decided(doc_id: int | None, points: int, marks: int) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) in code points, by the hash of the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((h1 % (points + 1), h2 % (points + 1)))
    form = "plain" if not points or marks or h3 % 100 >= 100 - PLAIN else "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    return form, lo, hi


def arranged(text: bytes, form: str, lo: int, hi: int) -> bytes:
    """The output for ``text``, cut at the bytes ``lo`` and ``hi``."""
    if form == "plain":
        return text
    p, s, m = (x.encode() for x in MARKS)
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that arranged() was given: marks occur in no text whose form isn't plain."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in MARKS)
    front, middle = output.split(m)
    if form == "psm":
        prefix, suffix = front[len(p) :].split(s)
    else:
        suffix, prefix = front[len(s) :].split(p)
    return prefix + middle + suffix


def _chunked(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into rows of ``size`` bytes: (rows, bytes that count, rows before each text and after the last)."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts])
    before = np.r_[0, np.cumsum(counts)]
    rows, sizes = np.zeros((before[-1], size), np.uint8), np.full(before[-1], size)
    flat = rows.reshape(-1)
    for t, i in zip(texts, before):
        flat[i * size : i * size + len(t)] = np.frombuffer(t, np.uint8)
    sizes[before[1:] - 1] = [len(t) - (n - 1) * size for t, n in zip(texts, counts.tolist())]
    return rows, sizes, before


def _made(doc_id: int | None, text: bytes, points: int, form: str, cuts: tuple[int, int], at: tuple[int, int], full: bool) -> tuple:
    output = arranged(text, form, *at)
    plain = form == "plain"
    row = (doc_id, points, form, None if plain else cuts[0], None if plain else cuts[1] - cuts[0], hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest())
    return (*row, output.decode()) if full else row


_COLUMNS = [("doc_id", pa.int64(), "long"), ("n", pa.int64(), "long"), ("form", pa.string(), "string"), ("prefix_chars", pa.int64(), "long"), ("middle_chars", pa.int64(), "long"), ("output_sha256", pa.string(), "string"), ("restored_sha256", pa.string(), "string"), ("output", pa.string(), "string")]


def _batch(rows: list[tuple], full: bool) -> pa.RecordBatch:
    kept = _COLUMNS if full else _COLUMNS[:-1]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k, _) in zip(zip(*rows) if rows else [()] * len(kept), kept)], [n for n, _, _ in kept])


def _schema(full: bool) -> str:
    return ", ".join(f"{n} {t}" for n, _, t in (_COLUMNS if full else _COLUMNS[:-1]))


def _near(docs: DataFrame, chunk: int, full: bool) -> DataFrame:
    """Texts that are read where they lie."""

    def some(ids: list, texts: list[bytes]) -> list[tuple]:
        rows, sizes, before = _chunked(texts, chunk)
        to, ends = functions(rows, sizes)
        out = []
        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            state, ended = entries(to[before[i] : before[i + 1]], ends[before[i] : before[i + 1]])
            marks, points = divmod(int(ended[-1]), _MARK)
            form, *cuts = decided(doc_id, points, marks)
            at = []
            for cut in cuts:
                k = min(int(np.searchsorted(ended[1:] % _MARK, cut)), len(state) - 2)
                at.append(k * chunk + place(text[k * chunk : (k + 1) * chunk], state[k], cut - int(ended[k] % _MARK)))
            out.append(_made(doc_id, text, points, form, tuple(cuts), tuple(at), full))
        return out

    def run(batches):
        for b in batches:
            ids, texts, size, rows = [], [], 0, []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("bytes").to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += max(chunk, len(text))
                if size > 1 << 22:
                    rows += some(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                rows += some(ids, texts)
            yield _batch(rows, full)

    return docs.select("doc_id", "bytes").mapInArrow(run, _schema(full))


def _far(docs: DataFrame, chunk: int, full: bool) -> DataFrame:
    """Giant texts: their chunks are dealt out, their functions composed by document, their cuts looked for by chunk."""
    keyed = docs.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("bytes", 256)), 256))
    pieces = F.transform(F.sequence(F.lit(1), F.octet_length("bytes"), F.lit(chunk)), lambda i: F.substring(F.col("bytes"), i, F.lit(chunk)))
    chunks = keyed.dropDuplicates(["key"]).select("key", "doc_id", F.posexplode(pieces).alias("place", "bytes")).repartition("key", "place")

    def scan(batches):
        for b in batches:
            parts = b.column("bytes").to_pylist()
            step = max(1, (1 << 22) // chunk)
            to, ends = [], []
            for i in range(0, len(parts), step):
                rows, sizes, _ = _chunked(parts[i : i + step], chunk)
                t, e = functions(rows, sizes)
                to += [x.tobytes() for x in t]
                ends += [x.tobytes() for x in e.astype("<i8")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), b.column("place"), pa.array(to, pa.binary()), pa.array(ends, pa.binary())], ["key", "doc_id", "place", "to", "ends"])

    scanned = chunks.mapInArrow(scan, "key string, doc_id long, place int, to binary, ends binary")
    listed = scanned.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "to", "ends"))).alias("all"))

    def select(batches):
        """For each cut of a text the chunk it falls into, the state that is entered in, and the code points left there."""
        for b in batches:
            out = []
            for key, doc_id, all_ in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "all"))):
                to = np.frombuffer(b"".join(x["to"] for x in all_), np.uint8).reshape(-1, _STATES)
                ends = np.frombuffer(b"".join(x["ends"] for x in all_), "<i8").reshape(-1, _STATES)
                state, ended = entries(to, ends)
                marks, points = divmod(int(ended[-1]), _MARK)
                form, *cuts = decided(doc_id, points, marks)
                for which, cut in enumerate(cuts):
                    k = min(int(np.searchsorted(ended[1:] % _MARK, cut)), len(state) - 2)
                    out.append((key, which, k, int(state[k]), cut - int(ended[k] % _MARK), cut, points, form))
            names = ["key", "which", "place", "state", "left", "cut", "points", "form"]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], names)

    wanted = listed.mapInArrow(select, "key string, which int, place int, state int, left long, cut long, points long, form string")

    def look(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("bytes", "state", "left")))
            at = np.array([place(*r) for r in rows], np.int64) + b.column("place").to_numpy().astype(np.int64) * chunk
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "which", "cut", "points", "form")), pa.array(at)], ["key", "which", "cut", "points", "form", "at"])

    met = wanted.join(chunks.drop("doc_id"), ["key", "place"]).select("key", "which", "place", "state", "left", "cut", "points", "form", "bytes")
    cuts = met.mapInArrow(look, "key string, which int, cut long, points long, form string, at long")
    plan = cuts.groupBy("key").agg(F.first("points").alias("points"), F.first("form").alias("form"), F.sort_array(F.collect_list(F.struct("which", "cut", "at"))).alias("cuts"))

    def write(batches):
        for b in batches:
            rows = []
            for doc_id, text, points, form, cuts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "bytes", "points", "form", "cuts"))):
                rows.append(_made(doc_id, text, points, form, tuple(c["cut"] for c in cuts), tuple(c["at"] for c in cuts), full))
            yield _batch(rows, full)

    return keyed.join(plan, "key").select("doc_id", "bytes", "points", "form", "cuts").mapInArrow(write, _schema(full))


def transformed(docs: DataFrame, chunk: int = CHUNK, giant: int = GIANT, giant_chunk: int = GIANT_CHUNK, full: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output if ``full``) of ``docs`` (doc_id, text).

    Chunks are of an even number of bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("bytes"))
    size = F.octet_length("bytes")
    return _near(rows.filter(size <= giant), chunk, full).unionByName(_far(spool(rows.filter(size > giant)), giant_chunk, full))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return transformed(read(spark, sf_dir, "documents"), full=False)


OP12_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (
  select *, ('0x' || h[1:8])::bigint % (n + 1) as a, ('0x' || h[9:16])::bigint % (n + 1) as b,
    case when text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (
  select *, least(a, b) as lo, greatest(a, b) as hi, left(text, least(a, b)) as prefix,
    substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) as middle, substring(text, greatest(a, b) + 1) as suffix from k)
select doc_id, n::bigint as n, form, case when form <> 'plain' then lo end::bigint as prefix_chars,
  case when form <> 'plain' then hi - lo end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
