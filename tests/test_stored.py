"""Intermediates that are written once: what was shuffled for them goes, and bouts aren't derived twice."""

import os

from pyspark.sql import functions as F

from boutlens.operators import graph
from boutlens.plans import assembled, learned, selections
from tests.conftest import SF


def shuffled():
    from pyspark import SparkContext

    root = SparkContext._active_spark_context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for d in root for _, _, fs in os.walk(d) for f in fs)


def test_shuffle_files_go(spark):
    before = shuffled()
    out = graph.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert shuffled() <= before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_same_date_events_derives_bouts_once(spark):
    plan = selections.same_date_events(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and plan.count("Join ") == 1


def test_stacker_derives_bouts_once(spark):
    """Neither fits nor predictions go back to the lines of orders."""
    assert "l_orderkey" not in learned.stacker_oof(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_matrix_is_folded_from_written_blocks(spark):
    """The last step reads no base table and ranks nothing: each block's shuffles went when it was written."""
    plan = assembled.feature_matrix_92(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Window" not in plan
