"""SimHash near-dedup over pivot distance tables.

A pivot table holds, for a slice of the 64 bits, the Hamming distances of each slice value to the same slice of many
reference fingerprints (pivots); a fingerprint's coordinates, its distances to all pivots, are sums over the slices.
Two fingerprints that differ in at most 3 of 64 bits agree on at least 3 of 6 slices (pigeonhole), so they meet under
at least one of 20 keys. Within a key, fingerprints are sorted by the pivot along which they spread most, and only
pairs at most 3 apart on it are formed; pairs are discarded by the maximum difference of their coordinates (it never
exceeds their Hamming distance), and survivors are verified.

Only distinct fingerprints meet. A key of more than ``CROWD`` of them is divided by the same rule: its free bits are cut
into 6 slices again, 3 of which two near fingerprints share, and so on; k free bits hold at most 2**k fingerprints, so
that this ends, and no two fingerprints within 3 bits are ever parted. A key's links are emitted as a spanning forest,
never as all pairs.

Null text counts as empty; a text without words has fingerprint zero and links like any other; texts are read whole,
however long; null doc_ids are dropped (they can't be members of a result keyed by id); repeated rows share their
component and give a row each; extra columns are ignored whatever their names; an empty table gives no rows.

The near-dedup stage (``drop_near``) looks for shingle similarity, of which 3 bits say little: at 0.8 a bit differs with
a chance of 0.15. It takes ``PRINTS`` independent fingerprints of a document. Candidates agree in two of their slices of
8 bits that make a key (at 0.8 all keys miss with a chance of about 0.0001) and differ by at most ``WIDE`` bits in the
first two fingerprints. Under a key documents are sorted along a pivot, pairs further apart on it than ``WIDE`` aren't
formed, and the rest are held bit by bit; then the shingles themselves are compared. Keys are compared in rounds: in
each a document goes by the least of those it is linked to so far, so that no link is made twice.
"""

from __future__ import annotations

import functools
import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import bitmap, components, free_name, spool, unspool, with_mark

RADIUS = 3
BLOCKS = 6
PIVOTS = 32
#: fingerprints under a key that are compared in one go; above it a key is divided
CROWD = 1024
#: the near-dedup stage: independent fingerprints of a document, and the bits by which candidates may differ in the first two
PRINTS, WIDE = 16, 36
#: documents of a group, and of a key, that one task compares; larger ones are dealt out, or thinned and dealt out by
#: pairs of parts. Bits in which a document may differ from a key's leader and be represented by it
CHUNK, KEY_CHUNK, CLOSE = 1000, 5000, 12
#: keys of as many documents are compared together, larger ones one by one; up to MATRIX by all pairs at once
SMALL, MATRIX = 64, 512
#: the first documents of a group are found to within one in so many of its documents
HEAD_ACCURACY = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EDGES = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
_TRIPLES = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
_SLICES = 8 * PRINTS
#: the pairs of slices that make a key, in rounds that are shuffled one after another: few keys first, which link most of a large group
_KEYS = [(i, (i + 1) % _SLICES) for i in range(_SLICES)] + [(i, i + _SLICES // 2) for i in range(0, _SLICES // 2, 2)]
_ROUNDS = [[n for n in range(len(_KEYS)) if lo <= n % 40 < hi] for lo, hi in ((0, 1), (1, 4), (4, 16), (16, 28), (28, 40))]


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of the word shingles of ``text``."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    join = b" ".join
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else (words,)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(join(s), seed) for s in shingles), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("doc_id is not null").mapInArrow(run, "doc_id long, fp long")


@functools.cache
def pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=np.uint64)


@functools.cache
def pivot_tables() -> list[np.ndarray]:
    """For each slice the distances (value, pivot)."""
    tables = []
    for lo, hi in zip(_EDGES, _EDGES[1:]):
        values = np.arange(1 << (hi - lo), dtype=np.uint64)
        slices = (pivots() >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        tables.append(np.bitwise_count(values[:, None] ^ slices[None, :]).astype(np.uint8))
    return tables


def _slices(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64) for lo, hi in zip(_EDGES, _EDGES[1:])]


def coordinates(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every pivot, summed up from the slice tables."""
    return sum(t[s] for t, s in zip(pivot_tables(), _slices(fp)))


def _cut(free: int) -> list[int]:
    """Masks of the ``BLOCKS`` slices of the set bits of ``free``."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    edges = [round(i * len(bits) / BLOCKS) for i in range(BLOCKS + 1)]
    return [sum(bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def _keyed(members: DataFrame) -> DataFrame:
    """(key, free, fp, node): a row for each member and choice of slices of its free bits; the key keeps the rest fixed."""

    def run(batches):
        cuts: dict = {}
        for b in batches:
            key, free, fp, node = (b.column(c).to_numpy() for c in ("key", "free", "fp", "node"))
            for mask in np.unique(free).tolist():
                mine = free == mask
                if mask not in cuts:
                    cuts[mask] = _cut(mask & (1 << 64) - 1)
                f, k = fp[mine].view(np.uint64), key[mine].view(np.uint64)
                rows = []
                for n, chosen in enumerate(_TRIPLES):
                    held = sum(cuts[mask][i] for i in chosen)
                    h = (k ^ np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ h >> np.uint64(29) ^ f & np.uint64(held)) * np.uint64(0xC2B2AE3D27D4EB4F)
                    rows.append((h ^ h >> np.uint64(32), np.full(len(f), (mask & (1 << 64) - 1) & ~held, np.uint64)))
                columns = [np.concatenate(c).view(np.int64) for c in zip(*rows)]
                again = [np.tile(x, len(_TRIPLES)) for x in (fp[mine], node[mine])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *again)], ["key", "free", "fp", "node"])

    return members.select("key", "free", "fp", "node").mapInArrow(run, "key long, free long, fp long, node long")


def _linked(fp: np.ndarray, node: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the fingerprints of one key: two lists of nodes."""
    far = coordinates(fp).astype(np.int8)
    axis = int(far.astype(np.int16).var(axis=0).argmax())
    order = np.argsort(far[:, axis], kind="stable")
    fp, node, far = fp[order], node[order], far[order]
    reach = np.searchsorted(far[:, axis], far[:, axis] + RADIUS, side="right")
    root, left, right = list(range(len(fp))), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fp)):
        a = np.arange(i + 1, reach[i])
        a = a[np.abs(far[a] - far[i]).max(axis=1, initial=0) <= RADIUS]
        a = a[np.bitwise_count(fp[a] ^ fp[i]) <= RADIUS]
        for j in a.tolist():
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                left.append(int(node[i]))
                right.append(int(node[j]))
    return left, right


def _pairs(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many keys of two fingerprints each, at once: ``fp`` and ``node`` have a row for each key."""
    near = np.abs(coordinates(fp[:, 0]).astype(np.int8) - coordinates(fp[:, 1]).astype(np.int8)).max(axis=1, initial=0) <= RADIUS
    near &= np.bitwise_count(fp[:, 0] ^ fp[:, 1]) <= RADIUS
    return node[near, 0], node[near, 1]


def _within_keys(keyed: DataFrame) -> DataFrame:
    """Links under each key; streams key by key through sorted partitions."""

    def emit(rows):
        key, fp, node = rows[0], rows[1].view(np.uint64), rows[2]
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        u, v = _pairs(fp[two[:, None] + [0, 1]], node[two[:, None] + [0, 1]]) if len(two) else (node[:0], node[:0])
        more = [_linked(fp[lo:hi], node[lo:hi]) for lo, hi in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist())]
        u = np.concatenate([u, *(np.array(x, np.int64) for x, _ in more)])
        v = np.concatenate([v, *(np.array(x, np.int64) for _, x in more)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(c).to_numpy() for c in ("key", "fp", "node")]
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
            if cut:
                yield emit([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None:
            yield emit(rest)

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def links(reps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between nodes of ``reps`` (fp distinct, node) that connect all fingerprints within 3 bits.

    ``crowd`` is 8 at least: 3 free bits hold no more, and can't be divided further.
    """
    members = reps.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"), "fp", "node")
    found = None
    while True:
        keyed = _keyed(members)
        sizes = spool(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        crowded = sizes.filter(F.col("n") > max(8, crowd)).select("key")
        some = keyed.join(sizes.filter(F.col("n") <= max(8, crowd)).select("key"), "key", "left_semi")
        found = _within_keys(some) if found is None else found.union(_within_keys(some))
        if crowded.isEmpty():
            return found
        members = spool(keyed.join(crowded, "key", "left_semi"))


def near_groups(docs: DataFrame, width: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of 3 bits or fewer."""
    prints = spool(fingerprints(docs, width))
    reps = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(reps, crowd))
    named = spool(reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), reps, found)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def similarity(a: str | None, b: str | None, width: int = 5) -> float:
    """Jaccard similarity of word shingles; fewer words than ``width`` are one shingle."""
    def shingles(text):
        w = (text or "").encode().translate(_LOWER).split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@functools.cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(65)
    return rng.integers(0, 2**64, PRINTS, np.uint64), rng.integers(0, 2**63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles of ``text``, ascending; fewer words than ``width`` are one shingle."""
    w = (text or "").encode().translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(w[i : i + width])) for i in range(max(1, len(w) - width + 1))), np.uint64))


def prints(h: np.ndarray) -> np.ndarray:
    """``PRINTS`` independent fingerprints of the distinct shingle hashes ``h``, as bytes: each mixes them in its own way."""
    flip, factor = _factors()
    total = np.zeros(64 * PRINTS, np.int64)
    for i in range(0, len(h), 255):
        x = (h[i : i + 255, None] ^ flip) * factor
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h))


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, a, b, keys): the first two fingerprints, and the slices of all, each a number with its place."""
    places = np.arange(_SLICES, dtype=np.int32) << 8

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            got = np.stack([prints(shingle_hashes(t, width)) for t in b.column("text").to_pylist()])
            first = np.ascontiguousarray(got[:, :16]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * _SLICES), pa.array((got + places).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(first[:, 0]), pa.array(first[:, 1]), keys], ["doc_id", "a", "b", "keys"])

    return texts.mapInArrow(run, "doc_id long, a long, b long, keys array<int>")


def _apart(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits by which the fingerprint pairs (a, b) and (x, y) differ."""
    return np.bitwise_count(a ^ x) + np.bitwise_count(b ^ y)


def _alike(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the candidate pairs among the members of a key: two lists of documents."""
    if len(doc) <= MATRIX:
        near = _apart(a[:, None], b[:, None], a, b) <= WIDE
        if near.sum() == len(doc):
            return [], []
        least, before = np.arange(len(doc)), None
        while before is None or (least != before).any():
            before, least = least, np.where(near, least, len(doc)).min(axis=1)
        below = np.flatnonzero(least < np.arange(len(doc)))
        return doc[least[below]].tolist(), doc[below].tolist()
    far, u, v = (coordinates(a) + coordinates(b)).astype(np.int16), [], []
    left, queue = np.arange(len(doc)), []
    while len(left):  # each is held once against those left
        if not queue:
            queue, left = [int(left[0])], left[1:]
        x = queue.pop()
        near = _apart(a[left], b[left], a[x], b[x]) <= WIDE
        near[near] = np.abs(far[left[near]] - far[x]).max(axis=1, initial=0) <= WIDE
        met = left[near].tolist()
        u += [int(doc[x])] * len(met)
        v += doc[met].tolist()
        queue += met
        left = left[~near]
    return u, v


def _together(key: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The candidate pairs of many small keys at once: every member is held against the next along a pivot, the one after, ..."""
    axis = int((coordinates(a[::64]).astype(np.int16) + coordinates(b[::64])).var(axis=0).argmax())
    along = _apart(a, b, pivots()[axis], pivots()[axis]).astype(np.int16)
    order = np.lexsort((along, key))
    key, doc, a, b, along = (x[order] for x in (key, doc, a, b, along))
    i, step, u, v = np.arange(len(key)), 1, [], []
    while True:
        i = i[: np.searchsorted(i, len(key) - step)]
        i = i[(key[i] == key[i + step]) & (along[i + step] - along[i] <= WIDE)]
        if not len(i):
            return u, v
        near = i[doc[i] != doc[i + step]]
        near = near[_apart(a[near], b[near], a[near + step], b[near + step]) <= WIDE]
        u.append(doc[near])
        v.append(doc[near + step])
        step += 1


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least of each component of the pairs (u, v) to its others: fewer than documents, however many pairs."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, least = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        p, q = least[x], least[y]
        apart = p != q
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (least[least] != least).any():
            least = least[least]
    below = least < np.arange(len(names))
    return names[least[below]], names[below]


def _compared(members: DataFrame, most: int | None) -> DataFrame:
    """(u, v, crowded) of ``members`` (key, doc_id, a, b): edges that connect the candidates under each key.

    Keys that are compared together give one forest. Members of the same doc_id are linked as it is. A key of over
    ``most`` documents is named in ``crowded`` instead, and isn't held.
    """

    def emit(rows):
        cuts = np.append(np.flatnonzero(np.diff(rows[0], prepend=rows[0][0] - 1)), len(rows[0]))
        size = np.diff(cuts)
        open_ = np.minimum.reduceat(rows[1], cuts[:-1]) < np.maximum.reduceat(rows[1], cuts[:-1])
        big = open_ & (size > (most or len(rows[0])))
        few = np.repeat(open_ & (size <= SMALL) & ~big, size)
        u, v = _together(*(x[few] for x in rows)) if few.any() else ([], [])
        for lo, hi in zip(cuts[:-1][open_ & (size > SMALL) & ~big].tolist(), cuts[1:][open_ & (size > SMALL) & ~big].tolist()):
            for out, found in zip((u, v), _alike(*(x[lo:hi] for x in rows[1:]))):
                out.append(np.array(found, np.int64))
        return edges(*_forest(np.concatenate([rows[1][:0], *u]), np.concatenate([rows[1][:0], *v])), rows[0][cuts[:-1][big]])

    def edges(u, v, crowded):
        columns = [pa.concat_arrays([pa.array(x), pa.nulls(len(crowded), pa.int64())]) for x in (u, v)]
        return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(crowded)])], ["u", "v", "crowded"])

    def run(batches):
        rest = over = None
        for b in batches:
            k, doc, x, y = (b.column(c).to_numpy() for c in ("key", "doc_id", "a", "b"))
            part = [k, doc, x.view(np.uint64), y.view(np.uint64)]
            if over is not None:
                part = [x[np.searchsorted(k, over, side="right") :] for x in part]
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            if not len(rest[0]):
                continue
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
            if cut:
                yield emit([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
            if most and len(rest[0]) > most:
                over = int(rest[0][0])
                yield edges(rest[1][:0], rest[1][:0], rest[0][:1])
                rest = [x[:0] for x in rest]
        if rest is not None and len(rest[0]):
            yield emit(rest)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long, crowded long")


def _led(members: DataFrame, chunk: int) -> tuple[DataFrame, list[DataFrame]]:
    """(members, edges): keys of more than ``chunk`` documents thinned by leaders, which lose no candidate.

    A key's least document leads: what differs from it in at most ``CLOSE`` bits leaves the key, and what differs by
    at most ``CLOSE`` more than a candidate may is linked to it, and so to whatever left. Rounds go on while they thin
    the keys by a tenth.
    """
    edges = []
    while True:
        big = spool(members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "a", "b")).alias("leader")).filter(F.col("n") > chunk))
        before = big.agg(F.sum("n")).first()[0]
        if not before:
            unspool(big)
            return members, edges
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("leader.a"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("leader.b")))
        met = members.join(big, "key").withColumn("apart", apart)
        linked = met.filter((F.col("apart") <= WIDE + CLOSE) & (F.col("doc_id") != F.col("leader.doc_id")))
        edges.append(spool(linked.select(F.col("leader.doc_id").alias("u"), F.col("doc_id").alias("v")).distinct()))
        stay = spool(met.filter(F.col("apart") > CLOSE).select("key", "doc_id", "a", "b"))
        left = stay.count()
        members = spool(members.join(big.select("key"), "key", "left_anti").unionByName(stay), members, big, stay)
        if left > 0.9 * before:
            return members, edges


def _dealt(members: DataFrame, chunk: int) -> DataFrame:
    """``members`` of crowded keys by pairs of parts of about half of ``chunk``: all pairs of a key's members meet."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / max(1, chunk // 2)).cast("int").alias("parts"))
    own = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("doc_id", "a", "b"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pair = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return own.select("key", "doc_id", "a", "b", "part", other).select(pair.alias("key"), "doc_id", "a", "b")


def candidates(texts: DataFrame, width: int = 5, chunk: int = KEY_CHUNK) -> DataFrame:
    """(u, v): every document v of ``texts`` (doc_id, text) that has a candidate, and the least, u, that candidates connect it to.

    After each round of keys documents go by the least of their component. A round's edges link components that were
    apart before it: fewer than its keys times those components (a divided key counts by its parts), whatever the pairs of a group.
    """
    own, found = spool(_sketches(texts, width)), None
    for numbers in _ROUNDS:
        keys = [(F.lit(n << 16) + F.get("keys", F.lit(i)) % 256 * 256 + F.get("keys", F.lit(j)) % 256).cast("long") for n in numbers for i, j in [_KEYS[n]]]
        named = own
        if found is not None:
            named = own.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("doc_id", F.coalesce("component", "doc_id"))
        keyed = named.select(F.explode(F.array(*keys)).alias("key"), "doc_id", "a", "b")
        met = spool(_compared(keyed, chunk))
        edges, spent = [met.filter("crowded is null").select("u", "v")], [met]
        crowded = met.filter("crowded is not null").select(F.col("crowded").alias("key"))
        if not crowded.isEmpty():
            members = spool(keyed.join(crowded, "key", "left_semi").distinct())
            apart = members.groupBy("key").agg((F.min("doc_id") < F.max("doc_id")).alias("apart")).filter("apart").select("key")
            members, led = _led(spool(members.join(apart, "key", "left_semi"), members), chunk)
            spent += [*led, spool(_compared(_dealt(members, chunk), None), members)]
            edges += [x.select("u", "v") for x in spent[1:]]
        if found is not None:
            edges.append(found.select(F.col("component").alias("u"), F.col("node").alias("v")))
            spent.append(found)
        found = components(reduce(DataFrame.unionByName, edges))
        unspool(*spent)
    unspool(own)
    return found.select(F.col("component").alias("u"), F.col("node").alias("v"))


class Kept:
    """The documents of a group that stay, found by shared shingles: sets alike by ``similar`` share one of their least."""

    def __init__(self, similar: float):
        self.similar, self.sets, self.holders = similar, [], {}

    def _least(self, h: np.ndarray) -> list[int]:
        return h[: len(h) - math.ceil(self.similar * len(h) - 1e-9) + 1].tolist()

    def alike(self, h: np.ndarray) -> bool:
        for i in sorted({i for x in self._least(h) for i in self.holders.get(x, ())}):
            if min(len(h), len(self.sets[i])) >= self.similar * max(len(h), len(self.sets[i])) - 1e-9:
                both = len(np.intersect1d(h, self.sets[i], assume_unique=True))
                if both / (len(h) + len(self.sets[i]) - both) >= self.similar:
                    return True
        return False

    def add(self, h: np.ndarray) -> None:
        for x in self._least(h):
            self.holders.setdefault(x, []).append(len(self.sets))
        self.sets.append(h)


def _judged(rows: DataFrame, width: int, similar: float, schema: str) -> DataFrame:
    """The documents of each (group, part) of ``rows`` (group, part, given, doc_id, text), in the order of doc_id.

    Those ``given`` come first and stay; of the others one stays unless it is ``similar`` to one that stays.
    """

    def run(batches):
        at = doc = kept = None
        own, out = [], []

        def settle():
            """Judges the document whose texts have all been read."""
            if own:
                group, part, given = at[0], at[1], doc[0]
                stays = given or not any(kept.alike(h) for h in own)
                if stays and (given or part is None):
                    for h in own:
                        kept.add(h)
                if not given:
                    out.append((group, doc[1], stays))

        for b in batches:
            for g, p, given, d, t in zip(*(b.column(c).to_pylist() for c in ("group", "part", "given", "doc_id", "text"))):
                if ((g, p), (given, d)) != (at, doc):
                    settle()
                    own.clear()
                    if (g, p) != at:
                        kept = Kept(similar)
                    at, doc = (g, p), (given, d)
                own.append(shingle_hashes(t, width))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["group", "doc_id", "stays"])
                out.clear()
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["group", "doc_id", "stays"])

    dealt = rows.repartition("group", "part").sortWithinPartitions("group", "part", F.desc("given"), "doc_id")
    return dealt.select("group", "part", "given", "doc_id", "text").mapInArrow(run, schema)


def _gone(alive: DataFrame, width: int, similar: float, chunk: int) -> list[DataFrame]:
    """The (doc_id) of ``alive`` (group, doc_id, text) that the sequential rule drops, as spools.

    In every round the first documents of each group by doc_id, about ``chunk``, are judged in order by one task. That
    is final, as all before them is. The rest of the group is dealt out in parts of about as many, held against those
    that stayed (given to each part), and what they beat goes for good; what is left takes part in the next round.
    """
    schema, lost = "group long, doc_id long, stays boolean", []
    steps = [2.0**-k for k in range(1, 31)]
    while True:
        size = alive.groupBy("group").agg(F.count("*").alias("n"), F.percentile_approx("doc_id", steps, F.lit(HEAD_ACCURACY)).alias("last"))
        halvings = F.least(F.ceil(F.log2(F.col("n") / chunk)), F.lit(len(steps)))
        crowded = spool(size.filter(F.col("n") > chunk).select("group", "n", F.element_at("last", halvings.cast("int")).alias("last")))
        dealt = alive.join(crowded, "group", "left")
        head = dealt.filter(F.col("last").isNull() | (F.col("doc_id") <= F.col("last")))
        judged = spool(_judged(head.select("group", F.lit(None).cast("int").alias("part"), F.lit(False).alias("given"), "doc_id", "text"), width, similar, schema))
        lost.append(judged.filter("not stays").select("doc_id"))
        if crowded.isEmpty():
            return lost
        rest = dealt.filter(F.col("doc_id") > F.col("last"))
        parts = F.ceil(F.col("n") / chunk).cast("int")
        stayed = head.join(judged.filter("stays").select("group", "doc_id").distinct(), ["group", "doc_id"], "left_semi").filter("n is not null")
        given = stayed.select("group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("given"), "doc_id", "text")
        others = rest.select("group", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), F.lit(False).alias("given"), "doc_id", "text")
        held = spool(_judged(given.unionByName(others), width, similar, schema))
        lost.append(held.filter("not stays").select("doc_id"))
        alive = spool(rest.select("group", "doc_id", "text").join(held.filter("stays").select("group", "doc_id").distinct(), ["group", "doc_id"], "left_semi"), alive)


def drop_near(docs: DataFrame, width: int = 5, similar: float = 0.8, chunk: int = CHUNK, key_chunk: int = KEY_CHUNK) -> DataFrame:
    """``docs`` without those whose shingles are ``similar`` to a document of smaller doc_id that stays.

    Groups are the components of the candidate pairs; the result is that of going through each group in the order of
    doc_id, whatever ``chunk``. Rows of null doc_id stay; rows that share a doc_id share their fate; other columns
    pass through whatever their names. The constants of the candidates are meant for a ``similar`` of 0.8 or more.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    groups = spool(candidates(texts, width, key_chunk).select(F.col("v").alias("doc_id"), F.col("u").alias("group")))
    bits = bitmap(groups.select(F.xxhash64("doc_id").alias("key")))
    alive = spool(with_mark(texts, F.xxhash64("doc_id"), bits, "__hit").filter("__hit").join(groups, "doc_id").select("group", "doc_id", "text"), groups)
    gone = spool(reduce(DataFrame.union, _gone(alive, width, similar, chunk)).distinct())
    hit, id_ = free_name(docs, "__hit"), free_name(docs, "__id")
    key = F.col("doc_id").cast("long")
    marked = with_mark(docs, F.xxhash64(key), bitmap(gone.select(F.xxhash64("doc_id").alias("key"))), hit)
    some = marked.filter(F.col(hit)).join(gone.withColumnRenamed("doc_id", id_), key == F.col(id_), "left_anti")
    return marked.filter(~F.col(hit)).select(docs.columns).union(some.select(docs.columns))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
