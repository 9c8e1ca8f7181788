"""From raw documents to packed training sequences: language, exact copies, near copies, passages, packing.

Every stage takes the columns of documents and, but for the last, returns them. Null texts have no language and go in
the first stage; rows of null doc_id can't be named as copies and stay; rows repeated in doc_id and text are one; of
rows that share a doc_id with different texts each is judged by its own text but for passages, which are cut from the
one of the least text. Texts are read whole, however long. An empty table stays empty, and further columns pass through
the filtering stages whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlens.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from boutlens.llm.common import free_name, learnable, read, spool

#: a document goes where no language holds this share of its words
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, no letter in the whole text, or none that most words are in) go.

    ``lang`` becomes the language found where it was null. Where nothing could be learnt all texts with a letter stay.
    """
    model = language_id.fit(docs, learnable())
    found, share = free_name(docs, "__language"), free_name(docs, "__share")
    out = language_id.predict(docs, model, docs.columns, (found, share))
    kept = out.filter((F.col(found) != "und") & (F.col(share) >= LEAST_SHARE)) if model[0] else out.filter(F.col("text").rlike(r"\p{L}"))
    if "lang" in docs.columns and model[0]:
        kept = kept.withColumn("lang", F.coalesce("lang", found))
    return kept.select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, once."""
    return exact_dedup.drop_copies(docs, exact_dedup.half_is_new())


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles are similar the first stays: candidates by independent fingerprints, see simhash."""
    return simhash.drop_near(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages copied from documents of smaller doc_id are cut; n_chars follows the text."""
    removed = free_name(docs, "removed")
    out = substring_dedup.dedup_passages(docs, removed).drop(removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens with their ids (little-endian unsigned 32-bit integers), neighbours on
    the curve packed together."""
    pieces = packing.pack(spool(packing.encoded(docs)))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", substring),
    ("packing", packed),
]

#: chaining and packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    spent = []
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), *spent)
        spent = [docs]
    return docs
