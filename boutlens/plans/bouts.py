"""Bouts and their sides derived from orders and line items."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutlens.operators.graph import stored

#: stored bouts by session and folder, seen only by the thread that is inside materialised()
_HELD: ContextVar[dict[tuple[SparkSession, str], DataFrame]] = ContextVar("held", default={})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with two suppliers or more: the two of the largest sums meet, the larger sum wins.

    The lines are shuffled once, by order; the sums and the ranks both use that partitioning.
    """
    held = _HELD.get().get((spark, sf_dir))
    if held is not None:
        return held
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    )
    sums = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.sum("cents").alias("cents"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("cents"), "l_suppkey"))
    pair = (
        sums.withColumn("place", place).filter("place <= 2").groupBy("l_orderkey")
        .agg(F.max(F.when(F.col("place") == 1, F.col("l_suppkey"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("l_suppkey"))).alias("second"))
        .filter("second is not null")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fight_id"), "o_custkey", F.to_date("o_orderdate").alias("event_date"), "o_orderpriority"
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("division"))
    return (
        pair.join(orders, F.col("l_orderkey") == F.col("fight_id")).join(customers, "o_custkey")
        .select(
            "fight_id", "event_date", "division", F.least("first", "second").alias("fighter_a"), F.greatest("first", "second").alias("fighter_b"),
            F.when(F.col("fight_id") % 10 != 0, F.col("first")).alias("winner"), method(F.col("o_orderpriority")).alias("method"),
        )
    )


@contextmanager
def materialised(spark: SparkSession, sf_dir: str):
    """Inside, bouts() is read back from where it was written once: a build of many features derives the bouts once."""
    before = _HELD.set(_HELD.get() | {(spark, sf_dir): stored(bouts(spark, sf_dir))})
    try:
        yield
    finally:
        _HELD.reset(before)


def method(priority):
    return (
        F.when(priority.startswith("1"), "KO/TKO").when(priority.startswith("2"), "Submission")
        .when(priority.startswith("5"), "DQ").otherwise("Decision")
    )


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per bout, one for each fighter; ``won`` is null for a draw."""
    b = bouts(spark, sf_dir)
    both = F.explode(F.array(
        F.struct(F.col("fighter_a").alias("fighter"), F.col("fighter_b").alias("opponent")),
        F.struct(F.col("fighter_b").alias("fighter"), F.col("fighter_a").alias("opponent")),
    ))
    return b.withColumn("side", both).select(
        "fight_id", "event_date", "division", "method", "side.fighter", "side.opponent", (F.col("winner") == F.col("side.fighter")).cast("int").alias("won")
    )
