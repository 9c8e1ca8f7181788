"""Substring dedup by collinear chaining.

Words are hashed, and of every ``WINDOW`` consecutive k-mers the least is a seed. A first pass counts the seeds of
several documents and sets their bits in a bitmap of fixed size; the second pass emits the seeds whose bit is set, so
that what one document alone holds isn't stored. Each seed that occurs in several documents is joined to its first
holder (least doc_id, then place): a star, never all pairs. Where the first holders of neighbouring seeds differ,
every ``UNIT`` of them together has a first holder of its own, so that a passage whose parts are known from
elsewhere still meets the document that holds all of it. A seed's second and later occurrences in a document are
also joined to the same occurrence elsewhere, so that repeats line up. Seeds of a document that point to the same
earlier document are merged into diagonal runs and chained by a Fenwick tree of prefix maxima under a linear gap
cost. Chains meet the other document's words page by page, are cut into blocks at runs, extended by equal words and
aligned word by word; chains of ``LEAST_WORDS`` or more whose alignment has a similarity of at least ``SIMILAR``
are fuzzy copies and are removed from the later document. A chain that fails is split at its largest gap, and its
parts are judged again.

Null text is null in the result and has no passages; an empty text stays. Rows of equal doc_id are one document,
the one of the least text: the others of them stay as they are, rows repeated in full share their fate; rows of null
doc_id stay. Ties between chains go to the smaller document, then place. Texts are decided on whole, however long:
a task holds one document's words and one chain. An empty table gives no rows; columns other than doc_id and text
pass through unchanged whatever their names, but for one of the name that the result's own column is given.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from boutlens.llm.common import MARK_BITS, bitmap, conf_held, free_name, spool, with_mark

K, WINDOW = 5, 6
LEAST_WORDS, SIMILAR = 40, 0.8
GAP_COST, BLOCK_WORDS, MARGIN = 0.3, 800, 24
#: seeds to a unit: they span at most K + WINDOW * (UNIT - 1) words, and so lie inside every exact passage of LEAST_WORDS
UNIT = 6
#: words to a page of a document that chains point to
PAGE = 1024


#: white space beyond ASCII, in UTF-8
_WIDE = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, the powers of another and of its inverse; bytes that are white space (1), or the first of it (2)."""
    values = np.random.default_rng(17).integers(0, 2**64, 257, np.uint64) | np.uint64(1)
    kinds = np.array([chr(i).isspace() if i < 128 else 0 for i in range(256)], np.uint8)
    kinds[[w[0] for w in _WIDE]] = 2
    return values[:256], *_powers(1 << 20), kinds


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.random.default_rng(17).integers(0, 2**64, 257, np.uint64)[256] | np.uint64(1)
    ones = np.full(n, base), np.full(n, pow(int(base), -1, 1 << 64), np.uint64)
    return np.cumprod(ones[0], dtype=np.uint64), np.cumprod(ones[1], dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of texts, those of str.split(), in order; number of words of each text).

    A word's hash is the sum of its bytes' numbers, each times a power by its place: a difference of running sums
    over all the bytes, brought to the word's start by a power of the inverse.
    """
    values, powers, inverse, kinds = _tables()
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join([*coded, b"  "]), np.uint8)
    kind = kinds[data]
    space = kind == 1
    wide = np.flatnonzero(kind == 2)
    if len(wide):
        three = data[wide].astype(np.int32) << 16 | data[wide + 1].astype(np.int32) << 8 | data[wide + 2]
        for size in (2, 3):
            codes = [int.from_bytes(w) << 24 - 8 * size for w in _WIDE if len(w) == size]
            at = wide[np.isin(three if size == 3 else three & 0xFFFF00, codes)]
            for i in range(size):
                space[at + i] = True
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = edges if space[0] else np.append(0, edges)
    start, stop = edges[0::2], edges[1::2]
    if len(data) > len(powers):
        powers, inverse = _powers(len(data))
    sums = values[data]
    sums *= powers[: len(data)]
    np.cumsum(sums, out=sums)
    h = sums[stop - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
    h[start > 0] *= inverse[start[start > 0] - 1]
    h += values[32] * powers[stop - start]
    h ^= h >> np.uint64(32)
    n = np.diff(np.searchsorted(start, np.cumsum([0, *(len(c) + 1 for c in coded)])))
    return h * np.uint64(0x9E3779B97F4A7C15), n


def seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hash, place) of the minimisers of texts, in order."""
    none = np.zeros(0, np.int64)
    h, n = word_hashes(texts)
    if len(h) < K:
        return none, none, none
    kmer = np.zeros(len(h) - K + 1, np.uint64)
    for i in range(K):
        kmer = (kmer ^ h[i : i + len(kmer)]) * np.uint64(0x9E3779B97F4A7C15)
        kmer ^= kmer >> np.uint64(29)
    first = np.cumsum(n) - n
    own = n >= K
    text, start, count = np.flatnonzero(own), first[own], n[own] - K + 1
    if not len(text):
        return none, none, none
    # windows that lie within a text; a text of fewer k-mers has one window of those
    windows = max(len(kmer) - WINDOW + 1, 0)
    least, pick = kmer[:windows].copy(), np.zeros(windows, np.uint8)
    for i in range(1, WINDOW):
        value = kmer[i : i + windows]
        pick[value < least] = i
        np.minimum(least, value, out=least)
    within = np.zeros(len(kmer) + 1, np.int8)
    long = count >= WINDOW
    within[start[long]] = 1
    within[start[long] + count[long] - WINDOW + 1] -= 1
    begin = np.flatnonzero(np.cumsum(within[:-1], dtype=np.int8))
    chosen = np.zeros(len(kmer), bool)
    chosen[begin + pick[begin]] = True
    for lo, n in zip(start[~long].tolist(), count[~long].tolist()):
        chosen[lo + int(kmer[lo : lo + n].argmin())] = True
    at = np.flatnonzero(chosen)
    of = np.searchsorted(start, at, side="right") - 1
    return text[of], kmer[at].view(np.int64), at - start[of]


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h.view(np.uint64) ^ x.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def all_seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hash, place, plain): seeds, then their second and later occurrences in a text, not plain,
    under hashes made with their number."""
    text, h, at = seeds(texts)
    # few occur again: those whose hash with the text's number does are put in order
    mixed = _mixed(h, text)
    ordered = np.sort(mixed)
    several = np.append(ordered[1:][ordered[1:] == ordered[:-1]], ordered[-1:])
    order = np.flatnonzero(several[np.searchsorted(several[:-1], mixed)] == mixed)
    order = order[np.lexsort((at[order], h[order], text[order]))]
    t, k = text[order], h[order]
    new = np.append(True, (np.diff(t) != 0) | (np.diff(k) != 0))[: len(t)]
    number = np.arange(len(t)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(t) else t
    again = number > 0
    more = order[again]
    plain = np.arange(len(h) + len(more)) < len(h)
    return np.append(text, text[more]), np.append(h, _mixed(h[more], number[again])), np.append(at, at[more]), plain


def _portions(batch: pa.RecordBatch, most: int = 1 << 18):
    """(doc_ids, texts) of a batch, about ``most`` characters at a time."""
    docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    lo = size = 0
    for hi, t in enumerate(texts, 1):
        size += len(t)
        if size >= most or hi == len(texts):
            yield np.array(docs[lo:hi], np.int64), texts[lo:hi]
            lo, size = hi, 0


def shared_seeds(own: DataFrame) -> np.ndarray:
    """A bitmap of ``MARK_BITS`` bits with those of all seeds that several documents hold."""

    def run(batches):
        for b in batches:
            for docs, texts in _portions(b):
                text, h, _, _ = all_seeds(texts)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(docs[text])], ["key", "doc_id"])

    held = own.mapInArrow(run, "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    with conf_held(own.sparkSession, {}):
        rows = bitmap(held.filter("first < last").select("key")).toArrow()
    bits = np.zeros(MARK_BITS // 64, np.int64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def _seed_rows(own: DataFrame, bits: np.ndarray) -> DataFrame:
    """(seed, doc_id, at, plain) of the seeds in ``bits``; not plain: a repeat under its own hash."""
    shared = own.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        words = shared.value
        for b in batches:
            for docs, texts in _portions(b):
                text, h, at, plain = all_seeds(texts)
                place = h & (MARK_BITS - 1)
                i = np.flatnonzero(words[place >> 6] >> (place & 63) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(docs[text[i]]), pa.array(at[i].astype(np.int32)), pa.array(plain[i])], ["seed", "doc_id", "at", "plain"])

    return own.mapInArrow(run, "seed long, doc_id long, at int, plain boolean")


def units(doc: np.ndarray, at: np.ndarray, other: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first seed) of ``UNIT`` neighbouring seeds of a document whose first holders or diagonals differ."""
    n = len(at) - UNIT + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.diff(at)
    seam = np.append(0, np.cumsum((np.diff(other) != 0) | (np.diff(to) != step)))
    far = np.append(0, np.cumsum((step > WINDOW) | (np.diff(doc) != 0)))
    i = np.flatnonzero((seam[UNIT - 1 :] > seam[:n]) & (far[UNIT - 1 :] == far[:n]))
    h = np.zeros(len(i), np.int64)
    for k in range(UNIT):
        h = _mixed(_mixed(_mixed(h, other[i + k]), to[i + k]), at[i + k] - at[i])
    return h, i


def _unit_rows(held: DataFrame) -> DataFrame:
    """(unit, doc_id, at, last): the units of the plain seeds with their first holders, those of the holders included."""
    names = ["unit", "doc_id", "at", "last"]

    def emit(rows):
        doc, at, _, _ = rows
        h, i = units(*rows)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc[i]), *(pa.array(at[x].astype(np.int32)) for x in (i, i + UNIT - 1))], names)

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "at", "other", "to")]
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
            if cut:
                yield emit([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None:
            yield emit(rest)

    ordered = held.select("doc_id", "at", "other", "to").repartition("doc_id").sortWithinPartitions("doc_id", "at", "other", "to")
    return ordered.mapInArrow(run, "unit long, doc_id long, at int, last int")


def runs(at: np.ndarray, to: np.ndarray) -> list[tuple[int, int, int]]:
    """Seeds merged where neighbours lie on one diagonal and touch: (start, length, start in the other text)."""
    order = np.lexsort((to, at))
    at, to = at[order], to[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != np.diff(to)) | (np.diff(at) > WINDOW + K)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] - at[first] + K).tolist(), to[first].tolist()))


def chain(pieces: list[tuple[int, int, int]]) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """Disjoint collinear chains of the runs, the best first."""
    if len(pieces) == 1:
        return [(float(pieces[0][1]), pieces)]
    ends = sorted({to + n for _, n, to in pieces})
    rank = {v: i + 1 for i, v in enumerate(ends)}
    size = len(ends)
    low = (-1e18, -1)
    tree = [low] * (size + 1)
    score, before = [0.0] * len(pieces), [-1] * len(pieces)
    pending = sorted(range(len(pieces)), key=lambda i: pieces[i][0] + pieces[i][1])
    done = 0
    for i in sorted(range(len(pieces)), key=pieces.__getitem__):
        at, n, to = pieces[i]
        while done < len(pending):  # what ends at or before this start may come before it, up to an overlap of K words
            j = pending[done]
            a, m, t = pieces[j]
            if a + m > at + K or a >= at:
                break
            value, x = (score[j] + GAP_COST / 2 * (a + m + t + m), j), rank[t + m]
            while x <= size:
                if value > tree[x]:
                    tree[x] = value
                x += x & -x
            done += 1
        best, x = low, bisect.bisect_right(ends, to + K)
        while x > 0:
            if tree[x] > best:
                best = tree[x]
            x &= x - 1
        gain = best[0] - GAP_COST / 2 * (at + to)
        if gain > 0 and pieces[best[1]][2] < to:
            score[i], before[i] = n + gain, best[1]
        else:
            score[i] = n
    used, out = set(), []
    for i in sorted(range(len(pieces)), key=lambda i: (-score[i], pieces[i])):
        if i in used:
            continue
        total, path, j = score[i], [], i
        while j >= 0 and j not in used:
            used.add(j)
            path.append(pieces[j])
            j = before[j]
        if j >= 0:
            total -= score[j]
        out.append((total, path[::-1]))
    return out


def _cuts(path: list[tuple[int, int, int]]) -> list[int]:
    """Where blocks of at most ``BLOCK_WORDS``, or of one run, begin in a chain, and its length."""
    out = [0]
    for i, piece in enumerate(path):
        if i > out[-1] and piece[0] + piece[1] - path[out[-1]][0] > BLOCK_WORDS:
            out.append(i)
    return [*out, len(path)]


def _chains(anchors: DataFrame) -> DataFrame:
    """(doc_id, chain, other, olo, ohi, runs): the chains of each document, the best first, with their runs laid end to end."""

    def choose(doc, other, at, to):
        found = []
        cuts = np.append(np.nonzero(np.diff(other))[0] + 1, len(other))
        lo = 0
        for hi in cuts.tolist():
            for value, path in chain(runs(at[lo:hi], to[lo:hi])):
                if path[-1][0] + path[-1][1] - path[0][0] >= LEAST_WORDS - MARGIN:
                    found.append((-value, int(other[lo]), path))
            lo = hi
        return [(doc, number, o, path[0][2], path[-1][2] + path[-1][1], [x for piece in path for x in piece]) for number, (_, o, path) in enumerate(sorted(found))]

    def chosen(rows):
        if not len(rows[0]):
            return []
        # most pairs of documents share a seed or two: only those whose seeds span a chain's least length are looked at
        new = np.flatnonzero(np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))
        span = rows[2][np.append(new[1:], len(rows[0])) - 1] - rows[2][new] + K
        rows = [x[np.repeat(span >= LEAST_WORDS - MARGIN, np.diff(np.append(new, len(rows[0]))))] for x in rows]
        cuts = np.append(np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1] - 1)), len(rows[0]))
        return [r for lo, hi in zip(cuts[:-1], cuts[1:]) for r in choose(int(rows[0][lo]), *(x[lo:hi] for x in rows[1:]))]

    names = ["doc_id", "chain", "other", "olo", "ohi"]

    def emit(rows):
        *plain, pieces = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in plain), pa.array(pieces, pa.list_(pa.int64()))], [*names, "runs"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "other", "at", "to")]
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
            rows = chosen([x[:cut] for x in rest])
            if rows:
                yield emit(rows)
            rest = [x[cut:] for x in rest]
        if rest is not None:
            rows = chosen(rest)
            if rows:
                yield emit(rows)

    ordered = anchors.repartition("doc_id").sortWithinPartitions("doc_id", "other", "at", "to")
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", runs array<long>")


def differences(a: list, b: list) -> int:
    """Edit distance of two word lists: a column of differences of one by one is held in the bits of two numbers."""
    if a == b:
        return 0
    lo = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[lo:], b[lo:]
    hi = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(b)) - 1
    up, down = every, 0
    for equal in [places.get(w, 0) for w in a]:
        flat = ((equal & up) + up ^ up | equal | down) & every
        more = (down | every ^ (flat | up)) << 1 | 1
        up, down = ((flat & up) << 1 | every ^ (flat | more)) & every, flat & more
    return len(a) + up.bit_count() - down.bit_count()


def _judged(words: list[str], there: list[str], shift: int, path: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, stop) of the fuzzy copies in a chain of runs; ``there[0]`` is word ``shift`` of the other text.

    A chain that fails is split at its largest gap and its parts are judged again, by alignments from run to run.
    """
    ends = [(at, to - shift) for at, _, to in path] + [(path[-1][0] + path[-1][1], path[-1][2] + path[-1][1] - shift)]

    def aligned(i, j):
        (lo, olo), (hi, ohi) = ends[i], ends[j]
        return differences(words[lo:hi], there[olo:ohi]), max(hi - lo, ohi - olo)

    def extended(i, j, wrong, long):
        (lo, x), (hi, y) = ends[i], (path[j - 1][0] + path[j - 1][1], path[j - 1][2] + path[j - 1][1] - shift)
        while lo > 0 and x > 0 and words[lo - 1] == there[x - 1]:
            lo, x, long = lo - 1, x - 1, long + 1
        while hi < len(words) and y < len(there) and words[hi] == there[y]:
            hi, y, long = hi + 1, y + 1, long + 1
        return (lo, hi) if hi - lo >= LEAST_WORDS and 1 - wrong / long >= SIMILAR else None

    cuts = _cuts(path)
    whole = extended(0, len(path), *map(sum, zip(*(aligned(i, j) for i, j in zip(cuts[:-1], cuts[1:])))))
    if whole or len(path) == 1:
        return [whole] if whole else []
    steps = [aligned(i, i + 1) for i in range(len(path))]
    own = [(differences(words[at : at + n], there[to - shift : to - shift + n]), n) for at, n, to in path]
    gap = [max(b[0] - a[0] - a[1], b[2] - a[2] - a[1]) for a, b in zip(path, path[1:])]
    out, parts = [], [(0, len(path))]
    while parts:
        i, j = parts.pop()
        if path[j - 1][0] + path[j - 1][1] - path[i][0] < LEAST_WORDS - MARGIN:
            continue
        found = j - i < len(path) and extended(i, j, *map(sum, zip(*steps[i : j - 1], own[j - 1])))
        if found:
            out.append(found)
        elif j - i > 1:
            k = max(range(i, j - 1), key=lambda x: gap[x]) + 1
            parts += [(i, k), (k, j)]
    return out


def _pages(texts: DataFrame) -> DataFrame:
    """(other, page, page_words): the words of the texts, ``PAGE`` to a row."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = text.split()
                rows += [(doc, i // PAGE, "\n".join(w[i : i + PAGE])) for i in range(0, len(w), PAGE)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["other", "page", "page_words"])

    return texts.mapInArrow(run, "other long, page long, page_words string")


def _slices(chains: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, chain, page, other, start, runs, words): a chain's stretch of the other document, a row for each page.

    ``start`` is the place of the row's first word; the runs come with the first page only.
    """
    reach = F.sequence(F.floor(F.greatest(F.col("olo") - MARGIN, F.lit(0)) / PAGE), F.floor((F.col("ohi") + MARGIN - 1) / PAGE))

    def run(batches):
        for b in batches:
            rows = []
            for doc, number, page, other, olo, ohi, path, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "chain", "page", "other", "olo", "ohi", "runs", "page_words"))):
                lo = max(0, olo - MARGIN, page * PAGE)
                words = text.split("\n")[lo - page * PAGE : ohi + MARGIN - page * PAGE]
                rows.append((doc, number, page, other, lo, path if page == max(0, olo - MARGIN) // PAGE else None, "\n".join(words)))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "chain", "page", "other", "start", "runs", "words"])

    asked = chains.select("doc_id", "chain", "other", "olo", "ohi", "runs", F.explode(reach).alias("page"))
    return asked.join(_pages(texts), ["other", "page"]).mapInArrow(run, "doc_id long, chain long, page long, other long, start long, runs array<long>, words string")


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of str.split() start and stop, in code points."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    space = _spaces()[np.minimum(code, 0x3001)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


@functools.cache
def _spaces() -> np.ndarray:
    return np.array([chr(i).isspace() for i in range(0x3002)])


class Passages:
    """The fuzzy copies in one document: chains are judged best first; words that a copy has taken count for no other."""

    def __init__(self, text: str):
        self.text, self.words, self.found = text, None, []

    def judge(self, other: int, start: int, path: list[tuple[int, int, int]], there: list[str]) -> None:
        if self.words is None:
            self.words = self.text.split()
            self.taken = np.zeros(len(self.words), bool)
        if path[-1][0] + path[-1][1] > len(self.words):
            return  # of another text under the same doc_id
        for lo, hi in _judged(self.words, there, start, path):
            free = np.flatnonzero(np.diff(np.concatenate([[True], self.taken[lo:hi], [True]]).astype(np.int8))) + lo
            self.found += [(x, y, other) for x, y in free.reshape(-1, 2).tolist()]
            self.taken[lo:hi] = True

    def spans(self) -> list[tuple[int, int, int, int, int]]:
        """(start, stop, other document) in words, and start and stop in code points, in order."""
        start, stop = places(self.text)
        return [(x, y, other, int(start[x]), int(stop[y - 1])) for x, y, other in sorted(self.found)]


_REMOVED = "array<struct<start:long,stop:long,source:long>>"
_SPANS = "array<struct<start:long,stop:long,source:long,lo:long,hi:long>>"


def _spans(texts: DataFrame, slices: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): the copies in each document, in words and in code points; ``mark`` is a hash of the text."""
    span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "source", "lo", "hi")]))
    first = texts.select("doc_id", F.lit(-1).cast("long").alias("chain"), F.xxhash64("text").alias("page"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("array<long>").alias("runs"), F.col("text").alias("words"))

    def run(batches):
        doc = mark = own = None
        parts, number = [], None  # of the chain at hand: (other, start, runs, words)

        def settle():
            if parts and own is not None:
                other, start, flat, _ = parts[0]
                if flat:
                    own.judge(other, start, [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)], "\n".join(p[3] for p in parts).split("\n"))
            parts.clear()

        for b in batches:
            out = []
            for d, c, page, other, start, flat, words in zip(*(b.column(x).to_pylist() for x in ("doc_id", "chain", "page", "other", "start", "runs", "words"))):
                if (d, c) != (doc, number):
                    settle()
                if c == -1:
                    if own is not None and own.found:
                        out.append((doc, mark, own.spans()))
                    doc, mark, own = d, page, Passages(words)
                elif d == doc:
                    parts.append((other, start, flat, words))
                number = c
            if out:
                yield emit(out)
        settle()
        if own is not None and own.found:
            yield emit([(doc, mark, own.spans())])

    def emit(rows):
        ids, marks, spans = zip(*rows)
        keys = ("start", "stop", "source", "lo", "hi")
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array([[dict(zip(keys, s)) for s in r] for r in spans], span)], ["doc_id", "mark", "spans"])

    both = first.unionByName(slices).repartition("doc_id").sortWithinPartitions("doc_id", "chain", "page")
    return both.mapInArrow(run, f"doc_id long, mark long, spans {_SPANS}")


def _first_holders(rows: DataFrame, key: str, ids: tuple[int | None, int | None]) -> DataFrame:
    """(key, first): the least (doc_id, at) of each key of several documents. Within 2^32 of doc_id both fit one number, which hashing aggregates."""
    low, high = ids
    most = F.max("doc_id").alias("most")
    if low is None or high - low >= 1 << 32:
        return rows.groupBy(key).agg(F.min(F.struct("doc_id", "at")).alias("first"), most).filter("first.doc_id < most").select(key, "first")
    both = (F.col("doc_id") - F.lit(low)) * F.lit(1 << 31) + F.col("at")
    first = F.struct((F.shiftright("both", 31) + F.lit(low)).alias("doc_id"), F.col("both").bitwiseAND((1 << 31) - 1).cast("int").alias("at"))
    return rows.groupBy(key).agg(F.min(both).alias("both"), most).select(key, first.alias("first"), "most").filter("first.doc_id < most").select(key, "first")


def find_passages(own: DataFrame) -> DataFrame:
    """(doc_id, mark, spans) of the documents ``own`` (doc_id, text; neither null) that hold copies of earlier ones."""
    found = spool(_seed_rows(own, shared_seeds(own)))
    ids = tuple(own.agg(F.min("doc_id"), F.max("doc_id")).first())
    first = spool(_first_holders(found, "seed", ids))
    held = spool(found.join(first, "seed").select("doc_id", "at", F.col("first.doc_id").alias("other"), F.col("first.at").alias("to"), "plain"), found, first)
    own_units = spool(_unit_rows(held.filter("plain")))
    first = spool(_first_holders(own_units, "unit", ids))
    ends = F.array(F.struct(F.col("at"), F.col("first.at").alias("to")), F.struct(F.col("last").alias("at"), (F.col("first.at") + F.col("last") - F.col("at")).alias("to")))
    by_units = own_units.join(first, "unit").filter("first.doc_id < doc_id").select("doc_id", F.col("first.doc_id").alias("other"), F.explode(ends).alias("x"))
    anchors = held.filter("other < doc_id").select("doc_id", "at", "other", "to").union(by_units.select("doc_id", "x.at", "other", "x.to"))
    chains = spool(_chains(anchors), held, own_units, first)
    met = spool(chains.select(F.explode(F.array("doc_id", "other")).alias("doc_id")).distinct())
    hit = with_mark(own, F.xxhash64("doc_id"), bitmap(met.select(F.xxhash64("doc_id").alias("key"))), "__met")
    texts = spool(hit.filter("__met").drop("__met").join(met, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), met)
    slices = spool(_slices(chains, texts), chains)
    return spool(_spans(texts, slices), texts, slices)


def dedup_passages(docs: DataFrame, out: str = "removed") -> DataFrame:
    """``docs`` with ``text`` freed of copied passages, and ``out``: array of (start, stop, source) in words."""
    docs = docs.drop(out)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = find_passages(own)
    names = [f.name for f in docs.schema.fields]
    hit, id_, mark, spans = (free_name(docs, n) for n in ("__hit", "__id", "__mark", "__spans"))
    key = F.xxhash64(F.col("doc_id").cast("long"))
    marked = with_mark(docs.withColumn("text", F.col("text").cast("string")), key, bitmap(found.select(F.xxhash64("doc_id").alias("key"))), hit)
    none = F.array().cast(_REMOVED).alias(out)
    rest = marked.filter(~F.col(hit)).select(*names, none)
    given = found.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("spans").alias(spans))
    met = marked.filter(F.col(hit)).join(given, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(mark)), "left")
    others = [n for n in names if n != "text"]

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("source", pa.int64())]))
        for b in batches:
            new, removed = [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column(spans).to_pylist()):
                parts, at = [], 0
                for s in gone or ():
                    parts.append(text[at : s["lo"]])
                    at = s["hi"]
                new.append("".join(parts) + text[at:] if parts else text)
                removed.append([{k: s[k] for k in ("start", "stop", "source")} for s in gone or ()])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in others), pa.array(new, pa.string()), pa.array(removed, span)], [*others, "text", out])

    schema = StructType([f for f in docs.schema.fields if f.name != "text"]).add("text", StringType()).add(out, DataType.fromDDL(_REMOVED))
    cut = met.select(*others, "text", spans).mapInArrow(run, schema)
    return rest.unionByName(cut.select(*names, out))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_passages(docs)
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), words.alias("removed_words"), F.col("removed.source").alias("sources"), F.col("removed.start").alias("starts"), F.col("removed.stop").alias("stops"))
