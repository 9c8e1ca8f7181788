"""Exact dedup: static binary-fuse filters over immutable snapshots screen the digests of a new batch.

A snapshot's distinct digests are dealt to digest buckets, one binary-fuse filter each (3 locations, 8-bit
fingerprints, about 9 bits a digest). The batch's duplicates are grouped among themselves; its distinct
digests meet the filter of their bucket, and only the positives are joined to the snapshot's exact buckets.
Texts travel only for digests that have a second holder, and are compared byte by byte.

Rows with null text count as empty text; a null doc_id takes part as an ordinary id that never wins; rows repeated in
doc_id and text are rows of one group, of which all with the winning id are kept; an empty batch or snapshot gives the
groups of the other; texts are compared whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import bitmap, free_name, spool, with_mark

MIN_BUCKETS = 64
DIGESTS_A_BUCKET = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BinaryFuse:
    """A static filter over distinct 64-bit keys: no false negatives, false positives near 1/256."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _places(keys, seed, segment, count):
        h = _mix(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        mark = (h ^ (h >> np.uint64(32))).astype(np.uint8)
        return np.stack([first, second, third]).astype(np.int64), mark

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, math.ceil(n * factor / segment) - 2)
        for seed in range(1, 1000):
            if seed % 8 == 0:
                count += max(1, count // 8)
            at, mark = cls._places(keys, seed, segment, count)
            size = (count + 2) * segment
            load = np.bincount(at.ravel(), minlength=size)
            alive, rounds = np.arange(len(keys)), []
            while len(alive):
                alone = load[at[:, alive]] == 1
                ready = alone.any(axis=0)
                if not ready.any():
                    break
                peeled = alive[ready]
                own = at[alone[:, ready].argmax(axis=0), peeled]
                rounds.append((peeled, own))
                load -= np.bincount(at[:, peeled].ravel(), minlength=size)
                alive = alive[~ready]
            if not len(alive):
                table = np.zeros(size, np.uint8)
                for peeled, own in reversed(rounds):
                    p = at[:, peeled]
                    table[own] = mark[peeled] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]]
                return cls(seed, segment, count, table)
        raise ValueError("no peeling order was found")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._places(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return (self.table[at[0]] ^ self.table[at[1]] ^ self.table[at[2]]) == mark

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        seed, segment, count = np.frombuffer(raw[:24], "<i8").tolist()
        return cls(seed, segment, count, np.frombuffer(raw[24:], np.uint8))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """A digest's second half as a number; the bucket comes from the first."""
    return np.array([int.from_bytes(d[-8:], "little") for d in column.to_pylist()], np.uint64)


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) of distinct ``digests`` (digest binary)."""

    def build(key, table):
        return pa.table({"bucket": [key[0].as_py()], "filter": [BinaryFuse.build(_keys(table["digest"])).to_bytes()]},
                        schema=pa.schema([("bucket", pa.int64()), ("filter", pa.binary())]))

    return digests.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, "bucket long, filter binary")


def write_filters(snapshot: DataFrame, path: str, digest=None) -> None:
    """The filters of a snapshot's texts, kept beside it: as it never changes, neither do they."""
    own = (digest or sha256)(F.coalesce(F.col("text").cast("string"), F.lit("")))
    digests = snapshot.select(own.alias("digest")).distinct()
    buckets = max(MIN_BUCKETS, digests.count() // DIGESTS_A_BUCKET)
    build_filters(digests, buckets).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(path)


def screen(digests: DataFrame, filters: DataFrame, buckets: int, parts: int = 1) -> DataFrame:
    """The distinct ``digests`` that their bucket's filter may hold; a bucket's digests are dealt out in ``parts``."""

    def probe(key, batch, held):
        if not len(held) or not len(batch):
            return batch.select(["digest"]).slice(0, 0)
        fuse = BinaryFuse.from_bytes(held["filter"][0].as_py())
        return batch.select(["digest"]).filter(pa.array(fuse.may_hold(_keys(batch["digest"]))))

    asked = digests.withColumns({"bucket": _bucket(buckets), "part": F.pmod(F.xxhash64("digest"), F.lit(parts))})
    held = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return asked.groupBy("bucket", "part").cogroup(held.groupBy("bucket", "part")).applyInArrow(probe, "digest binary")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup(docs: DataFrame, is_new: Column, digest=sha256, filters: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of ``docs``; of equal texts the largest doc_id stays.

    ``is_new`` tells the incoming batch from the immutable snapshot; ``digest`` may be any hash of the
    text, as equality is decided on bytes. ``filters`` is where write_filters() put the snapshot's; without it they
    are built.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), is_new.alias("is_new"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    rows = spool(texts.select("doc_id", "digest", "is_new"))
    held = rows.filter(~F.col("is_new")).groupBy("digest").agg(F.count("*").alias("n"))
    coming = rows.filter("is_new").groupBy("digest").agg(F.count("*").alias("n"))
    held, coming = spool(held), spool(coming)
    arrived = coming.count()
    if filters is None:
        buckets = max(MIN_BUCKETS, max(held.count(), arrived) // DIGESTS_A_BUCKET)
        positives = screen(coming.select("digest"), build_filters(held.select("digest"), buckets), buckets)
    else:
        kept = docs.sparkSession.read.parquet(filters)
        row = kept.select("buckets").first()
        buckets = row["buckets"] if row else MIN_BUCKETS
        positives = screen(coming.select("digest"), kept.select("bucket", "filter"), buckets, max(1, -(-arrived // (buckets * DIGESTS_A_BUCKET))))
    twice = spool(
        positives.join(held.select("digest"), "digest", "left_semi")
        .union(held.filter("n > 1").select("digest"))
        .union(coming.filter("n > 1").select("digest"))
        .distinct(),
        held, coming,
    )
    # Byte check: within a digest, grouping by the text itself; copies fold together before they are shuffled.
    # Texts that are marked by chance are groups of one.
    groups = spool(
        _marked(texts, twice).groupBy("digest", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
        twice,
    )
    clashing = spool(groups.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    if clashing.isEmpty():
        found = rows.join(groups.drop("text"), "digest", "left")
    else:  # unequal texts under one digest: these few are told apart by their texts
        plain = rows.join(clashing, "digest", "left_anti").join(groups.drop("text"), "digest", "left")
        mixed = texts.join(clashing, "digest", "left_semi").join(groups, ["digest", "text"])
        columns = ["doc_id", "digest", "keep_id", "group_size"]
        found = plain.select(columns).union(mixed.select(columns))
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, is_new: Column) -> DataFrame:
    """``docs`` without copies: of equal texts one row of the largest doc_id stays; rows of null doc_id all stay.

    Only rows whose doc_id's bit is set by a copy's are shuffled.
    """
    judged = dedup(docs, is_new).filter("group_size > 1 and doc_id is not null")
    verdicts = spool(judged.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept")))
    hit, digest, id_, known, kept = (free_name(docs, n) for n in ("__hit", "__digest", "__id", "__known", "__kept"))
    marked = with_mark(docs, F.xxhash64("doc_id"), bitmap(verdicts.select(F.xxhash64("doc_id").alias("key"))), hit)
    named = verdicts.select(F.col("doc_id").alias(id_), F.col("digest").alias(known), F.col("kept").alias(kept))
    some = marked.filter(F.col(hit)).withColumn(digest, sha256(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    met = some.join(named, (F.col("doc_id") == F.col(id_)) & (F.col(digest) == F.col(known)), "left")
    alone = met.filter(F.col(id_).isNull())
    winners = met.filter(F.col(kept)).dropDuplicates([id_, known])
    rest = marked.filter(~F.col(hit))
    return rest.select(docs.columns).union(alone.select(docs.columns)).union(winners.select(docs.columns))


def _marked(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """The ``texts`` whose digest's bit is set by any of ``digests``: all texts of those, and few others."""
    bits = bitmap(digests.select(F.xxhash64("digest").alias("key")))
    return with_mark(texts, F.xxhash64("digest"), bits, "__hit").filter("__hit").drop("__hit")


def half_is_new() -> Column:
    """For a table that doesn't say which rows came last: about half of them, by a hash of the id, count as the new batch."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(True))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup(docs, half_is_new())
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
