"""Shared plumbing of the training-data operators: reading, durable intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bits of a membership bitmap, 64 to a row: at most MARK_BITS / 64 rows to broadcast or gather, whatever the corpus
MARK_BITS = 1 << 26
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: bytes of an Arrow batch, where the session names none: 10,000 texts to a batch made a worker hold 80 MB more
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or what setCheckpointDir() was given.

    A local session that has neither gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="boutlens-"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
    return got.get()


@contextmanager
def conf_held(spark: SparkSession, settings: dict[str, str]):
    """The session with ``settings`` for as long as this lasts, and with small Arrow batches."""
    wanted = dict(settings)
    if spark.conf.get(_BATCH, None) is None:
        wanted[_BATCH] = BATCH_BYTES
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spool(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` written as zstd Parquet to the shared folder and read back: a cut in the lineage that outlives executors.

    ``spent`` are earlier spools that nothing reads any more: they are removed once this one is written. The
    shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boutlens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with conf_held(spark, {_CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    unspool(*spent)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.spooled_at = path
    return kept


def unspool(*spent: DataFrame) -> None:
    """Removes spools."""
    for df in spent:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.spooled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(keys: DataFrame) -> DataFrame:
    """(word, bits) of the hashes of the long column ``key``: a filter without false negatives, of bounded size.

    When it fills up it lets more through, which costs time and changes no result.
    """
    bit = F.pmod("key", F.lit(MARK_BITS))
    words = keys.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
    return words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def with_mark(df: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether bitmap() ``bits`` may hold the long ``key``."""
    bit = F.pmod(key, F.lit(MARK_BITS))
    marks = F.broadcast(bits.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits")))
    placed = df.withColumns({f"{name}_at": F.shiftright(bit, 6), f"{name}_bit": F.pmod(bit, F.lit(64)).cast("int")})
    met = placed.join(marks, F.col(f"{name}_at") == F.col(f"{name}_word"), "left")
    hit = F.coalesce(F.getbit(f"{name}_bits", F.col(f"{name}_bit")) == 1, F.lit(False))
    return met.withColumn(name, hit).drop(f"{name}_at", f"{name}_bit", f"{name}_word", f"{name}_bits")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def learnable(doc_id="doc_id"):
    """Rows whose labels may be learnt from: crc32 of the id's text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (u bigint, v bigint): (node, component), component the least node.

    Hook-and-contract: every round hooks each node below its least smaller neighbour, compresses those
    trees by pointer jumping, relabels the edges and drops the ones that became loops. Rounds are
    logarithmic in practice and each works on the contracted graph. Minima are partially aggregated, the
    lookups of a label are joins whose crowded side is a plain scan, so that a component holding a third of
    all rows is split by the skew join. Nulls and loops in ``edges`` are ignored; no edges give no rows.
    """
    edges = spool(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    labels = spool(
        edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
        .withColumn("component", F.col("node"))
    )
    while not edges.isEmpty():
        hooks = spool(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = spool(
                hooks.join(up, "root", "left").select(
                    "node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
                ),
                hooks,
            )
            hooks = jumped
            if jumped.filter("moved").isEmpty():
                break
        to_u = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        relabelled = (
            edges.join(to_u, "u", "left").join(to_v, "v", "left")
            .select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
            .filter("a <> b")
        )
        edges = spool(relabelled.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), edges)
        moved = hooks.select(F.col("node").alias("component"), F.col("root").alias("root"))
        labels = spool(
            labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
            labels, hooks,
        )
    unspool(edges)
    return labels
