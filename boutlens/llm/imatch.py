"""Document fingerprints by I-Match, in DataFrame functions only.

The lexicon is made of the terms whose share of the documents lies in a band; terms are counted by their 64-bit hash.
It is kept as a bitmap of ``BITS`` bits: a term outside the band passes where its bit is a lexicon term's, the same
way in every text, and with n terms in the lexicon about n / ``BITS`` of them do. n has a bound that doesn't depend on
the corpus: the mean number of distinct terms of a text over ``LOWEST_SHARE``.

A document's distinct terms of the lexicon are sorted; several scales of randomised lexicon subsets, each scale four
times sparser than the one before and each subset disjoint from its scale's others, keep some of them, and what a
subset keeps is hashed. Sparse subsets survive edits, dense ones serve short texts. Likeness is, at the scale
where it is greatest, the share of equal hashes among the subsets that hold a term of either document; scales
with fewer than ``FEWEST`` such subsets count only where no scale has more.

Null text counts as empty. Texts without a term of the lexicon use all their terms; texts without any term
use the text itself as their term. Whole texts are read, however long. Equal texts have equal fingerprints and likeness
1. Ties in doc_id are ordered by a hash of the text, repeated rows follow each other; rows of null doc_id come last, and
the first of them has no next. An empty table gives no rows. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 1 << 22
SCALES = 5
SUBSETS = 10
FEWEST = 4
LOWEST_SHARE, HIGHEST_SHARE = 1e-4, 0.2
_WORD_GAP = r"[^\p{L}\p{N}]+"
#: documents are dealt to ranges of doc_id to be met with their neighbours; a range is sorted, never held
BUCKET_ROWS = 3000
MOST_BUCKETS = 4096


def terms(text: Column) -> Column:
    """Sorted distinct term hashes of a text."""
    words = F.filter(F.split(F.lower(text), _WORD_GAP), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _bit(term: Column) -> Column:
    return term.bitwiseAND(F.lit(BITS - 1))


def lexicon(docs: DataFrame, low: float = LOWEST_SHARE, high: float = HIGHEST_SHARE) -> Column:
    """A bitmap literal (array of 64-bit words) of the terms whose share of documents lies in [low, high]."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = counts.filter(F.col("df").between(low * total, max(high * total, 1))).select(_bit(F.col("t")).alias("c"))
    bits = band.groupBy(F.shiftright("c", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("b"))
    words = [0] * (BITS // 64)
    for r in bits.collect():  # at most BITS / 64 rows, whatever the corpus
        words[r["w"]] = r["b"]
    return F.from_json(F.lit(str(words)), "array<bigint>")


def _held(words: Column, term: Column) -> Column:
    word = F.get(words, F.shiftright(_bit(term), 6).cast("int"))
    return F.getbit(word, term.bitwiseAND(F.lit(63)).cast("int")) == 1


def _thinned(scale: int):
    """A quarter of the terms, by their hash."""
    return lambda t: F.shiftrightunsigned(t, 40 + 2 * scale).bitwiseAND(F.lit(3)) == 0


def _in_subset(scale: int, subset: int):
    return lambda t: F.pmod(F.shiftrightunsigned(t, 23 + scale), F.lit(SUBSETS)) == subset


def with_print(df: DataFrame, text: str, out: str, words: Column) -> DataFrame:
    """``df`` with the sub-fingerprints of its column ``text`` as an array of longs, 0 for subsets without a term."""
    own, kept = f"__{out}_terms", f"__{out}_0"
    df = df.withColumn(own, terms(F.col(text)))
    df = df.withColumn(kept, F.filter(own, lambda t: _held(words, t)))
    df = df.withColumn(kept, F.when(F.size(kept) > 0, F.col(kept)).when(F.size(own) > 0, F.col(own)).otherwise(F.array(F.xxhash64(text))))
    parts, spare = [], [own, kept]
    for g in range(SCALES):
        if g:
            sparser = f"__{out}_{g}"
            df = df.withColumn(sparser, F.filter(kept, _thinned(g)))
            kept = sparser
            spare.append(kept)
        for k in range(SUBSETS):
            some = F.filter(kept, _in_subset(g, k))
            parts.append(some)
    subsets = F.transform(F.array(*parts), lambda s: F.when(F.size(s) > 0, F.xxhash64(s)).otherwise(F.lit(0)))
    return df.withColumn(out, subsets).drop(*spare)


def likeness(a: str, b: str) -> Column:
    """0 to 1 for two columns of with_print()."""
    shares = []
    for least in (FEWEST, 1):
        for g in range(SCALES):
            pairs = F.arrays_zip(F.slice(a, g * SUBSETS + 1, SUBSETS).alias("x"), F.slice(b, g * SUBSETS + 1, SUBSETS).alias("y"))
            used = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
            same = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
            shares.append(F.when(used >= least, same / used))
    first = F.greatest(*shares[:SCALES])
    return F.coalesce(first, F.greatest(*shares[SCALES:]), F.lit(0.0))


def text_of(fingerprint: str) -> Column:
    """The fingerprint as text: eight hex digits for each subset."""
    return F.array_join(F.transform(fingerprint, lambda s: F.lower(F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _range(rows: DataFrame) -> Column:
    """The range of doc_id that a row belongs to, from at most MOST_BUCKETS - 1 quantiles; -1 for null."""
    count = max(1, min(MOST_BUCKETS, rows.count() // BUCKET_ROWS))
    marks = [i / count for i in range(1, count)]
    cuts = rows.agg(F.percentile_approx("doc_id", marks, 100 * count)).first()[0] if marks else []
    below = F.lit(0)
    if cuts:
        cuts = F.array(*(F.lit(int(c)).cast("long") for c in sorted(set(cuts))))
        below = F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(below)


def beside_next(docs: DataFrame, columns: list[str], add=lambda df: df) -> DataFrame:
    """Each row of ``add(docs)`` with ``columns`` of the row of the next smaller doc_id (of the largest for the smallest) as ``next``.

    The last row of a range also visits the range after it, where it sorts first: ranges need nothing of each other.
    """
    placed = docs.withColumn("place", _range(docs.select("doc_id"))).withColumn("guest", F.lit(0))
    last = placed.filter("doc_id is not null").groupBy("place").agg(F.max("doc_id").alias("doc_id"))
    ring = Window.orderBy("place")  # one row a range
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    visits = last.select("place", "doc_id", F.coalesce(F.lead("place").over(ring), F.first("place").over(every)).alias("to"))
    moved = placed.join(F.broadcast(visits), ["place", "doc_id"]).groupBy("to").agg(F.max_by(F.struct(*docs.columns), F.xxhash64("text")).alias("r"))
    guests = moved.select("r.*", F.col("to").alias("place"), F.lit(1).alias("guest"))
    w = Window.partitionBy("place").orderBy(F.desc("guest"), "doc_id", F.xxhash64("text"))
    met = add(placed.unionByName(guests.select(placed.columns))).withColumn("next", F.lag(F.struct(*columns)).over(w))
    return met.filter("guest = 0").drop("guest", "place")


def edits(docs: DataFrame, words: Column) -> DataFrame:
    """Fingerprints of all texts, of their edited texts and their likeness; see op5_imatch for the edit."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = beside_next(rows, ["text", "fp"], lambda df: with_print(df, "text", "fp", words))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.coalesce("next.text", F.lit("")), F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", "edited", "fp", F.coalesce("next.fp", "fp").alias("next_fp"))
    return with_print(rows, "edited", "edited_fp", words)


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = edits(docs, lexicon(docs))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of("fp").alias("fingerprint"),
        text_of("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
