"""Hard-negative mining by bit-sliced integer products.

Components are integers, shifted to be non-negative and cut into bit-planes. A score's planes are added up most
significant first; after each plane the score lies in an interval whose width is what the planes left can add. A pair is
dropped as soon as its interval can't qualify: for a positive, when it ends below the fifth-best lower end of its
anchor; for a negative, when it meets no positive's window or ends below the third-best score known to lie in each that
it meets. Few pairs see the last planes, and those that do have exact scores.

The anchors (a stated query set) meet all rows in a grid of cells: a block of at most ``ANCHORS`` anchors by hash, and
a block of rows by hash. A task holds one block of anchors and streams the rows of its cell past it; a cell gives the
best few of each anchor, and these are merged over cells. Nothing goes through the driver or a broadcast but counts, and
a label or copy that holds a third of all rows is spread over all row blocks like any other.

Rows with a null label, vector or id, or with any null or non-finite component take no part. Exactly repeated rows are
one row; rows that share a vec_id but differ are separate rows, and a row is never the positive or the negative of an
anchor of its own vec_id. Ties go by smaller vec_id. Vectors of unequal length are read as ending in zeros; an empty
vector scores 0 with all. An empty table, or one without anchors, gives no rows; extra columns are ignored.
Components must be so small that no score leaves the range of a long; where some could, an error says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutlens.llm.common import read, spool

POSITIVES, NEGATIVES = 5, 3
#: anchors that a task holds, rows that it compares at a time, rows of a cell
ANCHORS, STEP, CELL = 2048, 4096, 1 << 18
#: a dense plane is worth while until so few of the pairs are left
SPARSE = 1 / 16
_LOWEST = np.iinfo(np.int64).min


def integer_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """(row_id, vec_id, label, v): the rows that take part; v holds floor(256 x) of each component, row_id names the row."""
    x = F.col("embedding").cast("array<double>").alias("embedding")
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    ints = rows.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c * 256)).alias("v"))
    return ints.distinct().select(F.sha2(F.to_json(F.struct("vec_id", "label", "v")), 256).alias("row_id"), "vec_id", "label", "v")


def _matrix(v: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    out = np.zeros((len(v), dims), np.int64)
    out[np.arange(dims) < np.diff(v.offsets.to_numpy())[:, None]] = v.flatten().to_numpy()
    return out


class Planes:
    """A block of anchors; sift() adds up their products with rows, the top bit-plane of the rows first."""

    def __init__(self, anchors: np.ndarray, bits: int):
        bound = anchors.shape[1] << 2 * bits + 1
        #: the kind of number that holds every partial sum without rounding
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.bits, self.whole, self.dense = bits, anchors, anchors.astype(self.kind)
        self.rise, self.fall = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)

    def sift(self, rows: np.ndarray, at: np.ndarray, may) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the pairs of ``rows`` with the anchors ``at`` that stay.

        ``may(row, anchor, low, high)`` says of pairs (index arrays that broadcast, ends of their intervals) which may
        still qualify.
        """
        shifted = rows + (1 << self.bits)
        held = self.dense[at].T
        score = np.repeat(-(self.whole[at].sum(axis=1) << self.bits).astype(self.kind)[None, :], len(rows), axis=0)
        plane, pairs = self.bits, None
        while pairs is None:
            score += ((shifted >> plane & 1).astype(self.kind) @ held) * self.kind(1 << plane)
            rest = (1 << plane) - 1
            live = may(np.arange(len(rows))[:, None], at[None, :], score + (rest * self.fall[at]).astype(self.kind), score + (rest * self.rise[at]).astype(self.kind))
            if plane == 0 or np.count_nonzero(live) <= SPARSE * live.size:
                pairs = np.nonzero(live)
            plane -= 1
        r, a = pairs[0], at[pairs[1]]
        total = score[pairs].astype(np.int64)
        while plane >= 0 and len(r):
            total += ((shifted[r] >> plane & 1) * self.whole[a]).sum(axis=1) << plane
            rest = (1 << plane) - 1
            stay = may(r, a, total + rest * self.fall[a], total + rest * self.rise[a])
            r, a, total = r[stay], a[stay], total[stay]
            plane -= 1
        return r, a, total


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` of each group by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    starts = np.r_[True, np.diff(group[order]) != 0][: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[place < most]


class _Best:
    """The first few (group, score, id) met so far, and in ``least`` the score that a new one must reach in each group."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, _LOWEST)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        keep = _first(group, score, ids, self.most)
        self.group, self.score, self.ids = group[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) == self.most)
        self.least[last] = self.score[np.searchsorted(self.group, last, side="right") - 1]


class _Positives:
    """The first rows of each anchor's label."""

    per = 1

    def __init__(self, planes: Planes, vec_id: np.ndarray, label: np.ndarray, scores: None):
        self.planes, self.vec_id, self.label = planes, vec_id, label
        self.best = _Best(len(vec_id), POSITIVES)

    def feed(self, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        kind = self.planes.kind
        none = kind(_LOWEST)
        for one in np.unique(label):
            own, at = np.flatnonzero(label == one), np.flatnonzero(self.label == one)
            if not len(at):
                continue
            least = self.best.least.astype(kind)

            def may(r, a, low, high):
                other = vec_id[own[r]] != self.vec_id[a]
                if low.ndim < 2:
                    return other & (high >= self.best.least[a])
                known = least[a[0]]
                if len(low) >= POSITIVES:  # the fifth-best lower end of this part
                    known = np.maximum(known, np.partition(np.where(other, low, none), len(low) - POSITIVES, axis=0)[len(low) - POSITIVES])
                return other & (high >= known)

            r, a, score = self.planes.sift(v[own], at, may)
            self.best.add(a, score, vec_id[own[r]])


class _Negatives:
    """The first rows of another label in the window of each positive."""

    per = POSITIVES

    def __init__(self, planes: Planes, vec_id: np.ndarray, label: np.ndarray, scores: np.ndarray):
        self.planes, self.vec_id, self.label = planes, vec_id, label
        # 50 s <= 100 x <= 95 s, which nothing is for a negative s, as places without a positive have
        self.floor = np.where(scores >= 0, (scores + 1) // 2, 1)
        self.ceiling = np.where(scores >= 0, scores // 20 * 19 + scores % 20 * 19 // 20, 0)
        self.best = _Best(self.floor.size, NEGATIVES)

    def feed(self, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        least = np.maximum(self.best.least.reshape(self.floor.shape), self.floor)
        held = self.planes.kind
        dense = (least.astype(held), self.ceiling.astype(held))

        def may(r, a, low, high):
            fit = (label[r] != self.label[a]) & (vec_id[r] != self.vec_id[a])
            floor, ceiling = dense if low.ndim > 1 else (least, self.ceiling)
            in_any = np.zeros(low.shape, bool)
            for p in range(POSITIVES):
                in_any |= (low <= ceiling[a, p]) & (high >= floor[a, p])
            return fit & in_any

        r, a, score = self.planes.sift(v, np.arange(len(self.vec_id)), may)
        groups, scores, ids = [], [], []
        for p in range(POSITIVES):
            fit = (score <= self.ceiling[a, p]) & (score >= self.floor[a, p])
            groups.append(a[fit] * POSITIVES + p)
            scores.append(score[fit])
            ids.append(vec_id[r[fit]])
        self.best.add(*map(np.concatenate, (groups, scores, ids)))


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, row_blocks: int) -> DataFrame:
    """Both sides under ``cell``, the anchors (``kind`` 0) before the rows (1): anchors go to every block of rows, rows
    to every block of anchors."""
    side = F.pmod(F.xxhash64("row_id"), F.lit(blocks))
    part = F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(row_blocks))
    columns, scores = ["vec_id", "label", "v"], anchors.schema["scores"].dataType
    left = anchors.select("row_id", *columns, "scores", side.alias("side"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("part"))
    right = rows.select(F.lit(None).cast("string").alias("row_id"), *columns, F.lit(None).cast(scores).alias("scores"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("side"), part.alias("part"))
    cell = (F.col("side") * row_blocks + F.col("part")).alias("cell")
    both = left.select(cell, F.lit(0).alias("kind"), "row_id", *columns, "scores").unionByName(right.select(cell, F.lit(1).alias("kind"), "row_id", *columns, "scores"))
    return both.repartition("cell").sortWithinPartitions("cell", "kind")


def _found(cells: DataFrame, search: type, bits: int, dims: int) -> DataFrame:
    """What ``search`` finds in each cell: (row_id of the anchor, which of its positives, score, partner)."""

    def run(batches):
        cell, asked, look, names = None, [], None, None

        def began():
            """The anchors of the cell are all there."""
            table = pa.Table.from_batches(asked).combine_chunks()
            scores = [(s or []) + [-1] * (POSITIVES - len(s or [])) for s in table.column("scores").to_pylist()]
            planes = Planes(_matrix(table.column("v").combine_chunks(), dims), bits)
            return search(planes, *(table.column(c).to_numpy() for c in ("vec_id", "label")), np.array(scores, np.int64)), table.column("row_id").combine_chunks()

        def done():
            if look is not None:
                best, per = look.best, look.per
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best.group // per)), pa.array((best.group % per).astype(np.int32)), pa.array(best.score), pa.array(best.ids)], ["row_id", "which", "score", "partner"])

        for b in batches:
            key = b.column("cell").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            cuts = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                at, kind = divmod(int(key[lo]), 2)
                if at != cell:
                    yield from done()
                    cell, asked, look = at, [], None
                if kind == 0:
                    asked.append(b.slice(lo, hi - lo))
                elif asked:
                    if look is None:
                        look, names = began()
                    for i in range(lo, hi, STEP):
                        some = b.slice(i, min(STEP, hi - i))
                        look.feed(some.column("vec_id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("v"), dims))
        yield from done()

    return cells.mapInArrow(run, "row_id string, which int, score long, partner long")


def mine(rows: DataFrame, anchors: Column, block: int = ANCHORS, cell: int = CELL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the ``anchors`` among integer_rows()."""
    rows = spool(rows)
    asked = rows.filter(anchors)
    n, most, dims = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -1 - c)))), F.max(F.size("v"))).first()
    dims, bits = max(1, dims or 0), max(1, int(most or 0).bit_length())
    if dims << 2 * bits >= 1 << 61:
        raise ValueError(f"components of {bits} bits in {dims} dimensions: scores may leave the range of a long")
    blocks = max(1, -(-asked.count() // block))
    row_blocks = max(-(-n // cell), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = _found(_cells(asked.withColumn("scores", F.lit(None).cast("array<long>")), rows, blocks, row_blocks), _Positives, bits, dims)
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "partner"))
    positives = met.withColumn("place", place).filter(F.col("place") <= POSITIVES)
    listed = positives.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("place", "score", "partner"))).alias("found"))
    found = spool(asked.join(listed, "row_id").withColumn("scores", F.col("found.score")))
    met = _found(_cells(found, rows, blocks, row_blocks), _Negatives, bits, dims)
    rank = F.row_number().over(Window.partitionBy("row_id", "which").orderBy(F.desc("score"), "partner"))
    chosen = met.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    named = found.select("row_id", F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("which", "one"))
    return named.join(chosen, ["row_id", "which"]).select(
        "anchor_id", F.col("one.partner").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("partner").alias("negative_id"),
        F.col("one.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(integer_rows(read(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 50 == 0)


OP11_SQL = """
with r as (
  select distinct vec_id::bigint as vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select a.vec_id as anchor_id, a.label, r.vec_id as id, r.label = a.label as same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::bigint as score
  from r a join r on r.vec_id <> a.vec_id where a.vec_id % 50 = 0),
pos as (
  select anchor_id, id as positive_id, score as positive_score from p where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank,
  id as negative_id, positive_score, score as negative_score
from pos join p using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
