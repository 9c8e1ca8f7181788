"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the last one or two line hashes ends a chunk where it is 0 modulo ``SPREAD``; the same hash's next
bits say which lines a chunk may begin with. A chunk runs from such a line, or from an end, to the next end, so that
its bounds depend on its own lines and survive shifts, whatever stands around them. ``ROLLS`` such hashes cut every
text in as many ways: a repeated passage that one way cuts badly another cuts well. Chunks begin at most ``REACH`` lines
before their end, or after an end, so that their number and their text stay in proportion to the lines. Chunks of at
least two lines that occur more than once in the corpus, compared byte by byte, stay where they occur first (by doc_id, text hash, place), and their lines are removed
elsewhere. A first pass counts chunk hashes and sets the bits of the repeated ones in a bitmap of fixed size, so that
only chunks whose bit is set carry their text, and only documents that lose lines are shuffled.

Null text is null in the result with no lines; an empty text is one empty line. Rows of one doc_id and equal
text are the same document and share their fate; null doc_ids sort first. Whole texts are cut, however long: work grows
with a text's lines, not with their square. An empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.common import bitmap, spool, with_mark

SPREAD, LEAST_LINES = 2, 2
#: (lines a hash rolls over, its seed); so many find nine tenths of the lines in repeated runs of two or more
ROLLS = [(1, 0), (1, 1), (2, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8)]
REACH = 8
_SHIFT = 1 << 32


def _code(lo: Column, hi: Column) -> Column:
    """A chunk's first and last line, from 1, as one number."""
    return lo * F.lit(_SHIFT) + hi


def _lo(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _size(code: Column) -> Column:
    return (code.bitwiseAND(F.lit(_SHIFT - 1)) - F.shiftright(code, 32) + 1).cast("int")


def _rolled(over: int, seed: int) -> Column:
    if over == 1:
        return F.transform("hashes", lambda h: F.xxhash64(h, F.lit(seed)))
    return F.zip_with("before", "hashes", lambda a, h: F.xxhash64(a, h, F.lit(seed)))


def _between(rolled: str):
    """The codes of the chunks that end at line ``hi`` where the one before ended at ``lo``."""
    none = F.array().cast("array<bigint>")
    begins = lambda i: F.pmod(F.shiftright(F.get(rolled, i - 1), 20), F.lit(SPREAD)) == 0

    def codes(lo, hi):
        near = F.filter(F.sequence(F.greatest(lo + 1, hi - REACH + 1), hi - 1), lambda i: (i == lo + 1) | begins(i))
        inside = F.when(hi - lo >= LEAST_LINES, F.transform(near, lambda i: _code(i, hi))).otherwise(none)
        whole = F.when(hi - lo > REACH, F.array(_code(lo + 1, hi))).otherwise(none)
        over = F.when((lo >= 1) & (hi - lo < REACH) & begins(lo), F.array(_code(lo, hi))).otherwise(none)
        return F.concat(inside, whole, over)

    return codes


def with_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the ``lines`` of a text, their ``hashes``, and the codes of its ``chunks`` of LEAST_LINES or more.

    Every step is a column of its own: an expression inside a lambda would be evaluated anew for each element.
    """
    df = df.withColumn("lines", F.split(text, "\n")).withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    df = df.withColumn("before", F.concat(F.array(F.lit(None).cast("long")), F.slice("hashes", 1, F.size("hashes") - 1)))
    codes = []
    for n, (over, seed) in enumerate(ROLLS):
        df = df.withColumn(f"rolled{n}", _rolled(over, seed))
        places = F.transform(f"rolled{n}", lambda r, i: F.when(F.pmod(r, F.lit(SPREAD)) == 0, i + 1).otherwise(0))
        df = df.withColumn(f"ends{n}", F.array_union(F.array_remove(places, 0), F.array(F.size("lines"))))
        df = df.withColumn(f"starts{n}", F.concat(F.array(F.lit(0)), F.slice(f"ends{n}", 1, F.size(f"ends{n}") - 1)))
        df = df.withColumn(f"codes{n}", F.flatten(F.zip_with(f"starts{n}", f"ends{n}", _between(f"rolled{n}"))))
        codes.append(f"codes{n}")
    spare = [f"{c}{n}" for c in ("rolled", "ends", "starts", "codes") for n in range(len(ROLLS))]
    return df.withColumn("chunks", F.array_distinct(F.concat(*codes))).drop("before", *spare)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, removed_lines, removed_chunks): ``text`` without the lines of removed chunks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    cut = with_chunks(rows).select("doc_id", "mark", "lines", "hashes", "chunks")
    digest = lambda c: F.xxhash64(F.slice("hashes", _lo(c), _size(c)))
    keys = cut.select(F.explode(F.transform("chunks", digest)).alias("key"))
    repeated = spool(bitmap(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")))
    words = lambda c: F.array_join(F.slice("lines", _lo(c), _size(c)), "\n")
    each = cut.select("doc_id", "mark", F.explode(F.transform("chunks", lambda c: F.struct(c.alias("code"), digest(c).alias("hash"), words(c).alias("chunk")))).alias("c"))
    held = with_mark(each.select("doc_id", "mark", "c.code", "c.hash", "c.chunk"), F.col("hash"), repeated, "hit").filter("hit").drop("hit")
    held = spool(held, repeated)
    place = F.struct("doc_id", "mark", "code")
    first = spool(held.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    gone = spool(
        held.join(first, ["hash", "chunk"]).filter(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "mark").agg(F.collect_set("code").alias("gone")),
        held, first,
    )
    key = F.xxhash64("doc_id", "mark")
    marked = with_mark(rows, key, bitmap(gone.select(key.alias("key"))), "hit")
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    whole = marked.filter(~F.col("hit")).select("doc_id", "text", total.alias("n_lines"), F.lit(0).cast("long").alias("removed_lines"), F.lit(0).cast("long").alias("removed_chunks"))
    some = marked.filter("hit").join(gone.withColumnsRenamed({"doc_id": "d", "mark": "m"}), (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    some = some.withColumn("lines", F.split("text", "\n")).withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    places = F.transform("gone", lambda c: F.sequence(_lo(c), _lo(c) + _size(c) - 1))
    some = some.withColumn("kept", F.array_except(F.sequence(F.lit(1), F.size("lines")), F.flatten(places)))
    left = some.withColumn("left", F.transform("kept", lambda i: F.element_at("lines", i)))
    cleaned = left.select(
        "doc_id", F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join("left", "\n")).alias("text"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("removed_lines"), F.size("gone").cast("long").alias("removed_chunks"),
    )
    return whole.unionByName(cleaned)


def op10_line_chunks(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_chunks", F.sha2("text", 256).alias("text_sha256"))
