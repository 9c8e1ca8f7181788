"""Writers of tables and files.

A replaced partition goes through dynamic overwrite; tables that are merged into by key are those of snapshots.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlens.operators import evaluation


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """The partitions that ``rows`` has are replaced, others stay: running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    """One partition goes, as features of a version do before they are computed anew."""
    fs, p = _fs(spark, f"{path}/{column}={value}")
    fs.delete(p, True)


def finite(rows: DataFrame) -> DataFrame:
    """Doubles that are no number, or infinite, become null: JSON knows neither."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return rows.select(*(F.when(~bad(n), F.col(n)).alias(n) if kind in ("double", "float") else F.col(n) for n, kind in rows.dtypes))


def append_alias(old: DataFrame, raw: DataFrame, key: str, aliases: str = "alias_list") -> DataFrame:
    """``old`` with the names of ``raw`` (key, name) added to their array of aliases, each once; new keys begin one."""
    names = raw.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("__names"))
    met = old.join(names, key, "full")
    joined = F.array_union(F.coalesce(aliases, F.array().cast("array<string>")), F.coalesce("__names", F.array().cast("array<string>")))
    return met.select(*(joined.alias(aliases) if c == aliases else F.col(c) for c in old.columns))


def export_csv(rows: DataFrame, path: str) -> None:
    """A header, nulls as nothing, dates in ISO form."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("dateFormat", "yyyy-MM-dd").csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    """One object a line, nulls written, doubles finite."""
    finite(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a row, added to what is there."""
    finite(rows).withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def ranked_json(results: DataFrame, path: str, metric: str, ties: str) -> None:
    """Results with their rank by a metric, as JSON; rows of one value fold before the ranks are counted."""
    ranked = evaluation.with_position(results, [metric, ties], "rank")
    export_json(ranked.withColumn("rank", (F.col("rank") + 1).cast("long")), path)


def with_sidecar(rows: DataFrame, path: str, sidecar: str, facts: dict) -> None:
    """A Parquet table, and a JSON file of what it was made from."""
    rows.write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    fs, p = _fs(spark, sidecar)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
    out.close()


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of them as a multiset: whatever their order, a changed, lost or doubled row changes it."""
    own = rows.select(F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\\N")).alias(c) for c in rows.columns))), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 13 * i, 13), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]
    n, *sums = own.agg(F.count("*"), *parts).first()
    return n, ":".join(str(x) for x in sums)


def round_trip(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written and read back under their own schema; another content than was written raises."""
    rows.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if digest(back) != digest(rows):
        raise ValueError(f"{path} doesn't hold what was written")
    return back


def write_valid(valid: DataFrame, rejected: DataFrame, path: str) -> dict[str, int]:
    """Both parts of a checked input, and how many rows each has."""
    valid.write.mode("overwrite").parquet(f"{path}/valid")
    rejected.write.mode("overwrite").parquet(f"{path}/rejected")
    spark = valid.sparkSession
    return {k: spark.read.parquet(f"{path}/{k}").count() for k in ("valid", "rejected")}
