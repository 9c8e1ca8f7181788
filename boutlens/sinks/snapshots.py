"""Tables of snapshots: merges by key that touch only the buckets of their keys, readable at any time.

A table is a folder: ``data`` holds a folder for every bucket that a merge wrote, ``manifests`` a file for every
version, which names the folder of each bucket. Nothing that a manifest names is ever changed. A merge writes the
buckets of its keys anew and then, as its last step, the next manifest under a name of its own, by a rename that fails
where that version exists. Readers follow the highest manifest: they see the table before a merge or after it, never
between, whatever fails on the way; of two merges at once one gets an error and can be run again. Folders that no kept
version names are removed by vacuum().

Keys may be null: rows of equal or null keys are one. A merge's own rows of one key must have been folded to one;
columns of the rows that the table doesn't have are left out, missing ones are null.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "__bucket"
_VERSION = re.compile(r"v(\d{12})\.json$")


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = got.get()
    return f"{base}/boutlens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, the oldest first."""
    fs, p = _at(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    found = (_VERSION.search(s.getPath().getName()) for s in fs.listStatus(p))
    return sorted(int(m[1]) for m in found if m)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version is made of: keys, schema, number of buckets and their folders; None where there is no table."""
    held = versions(spark, path)
    if not held:
        return None
    at = held[-1] if version is None else version
    if at not in held:
        raise ValueError(f"{path} has no version {at}")
    return json.loads(_read_text(spark, f"{path}/manifests/v{at:012d}.json"))


def _frame(spark: SparkSession, path: str, found: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the latest by default."""
    found = manifest(spark, path, version)
    if found is None:
        raise ValueError(f"{path} is no table of snapshots")
    return _frame(spark, path, found, sorted(found["buckets"].values()))


def _commit(spark: SparkSession, path: str, version: int, found: dict) -> None:
    """Puts a manifest under its version, once."""
    fs, folder = _at(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    _, fresh = _at(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
    out.close()
    _, named = _at(spark, f"{path}/manifests/v{version:012d}.json")
    if fs.exists(named) or not fs.rename(fresh, named):
        fs.delete(fresh, False)
        raise Conflict(f"version {version} of {path} was committed by another writer")


def _bucket(keys: list[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(_BUCKET)


def _write(spark: SparkSession, path: str, rows: DataFrame, buckets: int, touched: list[int]) -> dict[str, str]:
    """Folders of the ``touched`` buckets, written anew from ``rows`` (with the bucket); an empty bucket has none."""
    own = f"data/{uuid.uuid4().hex}"
    rows.repartition(min(buckets, max(1, len(touched))), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{own}")
    fs, _ = _at(spark, path)
    named = {k: f"{own}/{_BUCKET}={k}" for k in touched}
    return {str(k): f for k, f in named.items() if fs.exists(_at(spark, f"{path}/{f}")[1])}


def merged(old: DataFrame, new: DataFrame, keys: list[str], nulls_overwrite: bool) -> DataFrame:
    """``old`` with ``new`` put in by key, nulls among the keys being equal."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in values if c in new.columns))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        same = one if same is None else same & one
    met = old.withColumn("__old", F.lit(True)).join(fresh, same, "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__key_{c}"))
        if c not in new.columns:
            return F.col(c)
        return F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) if nulls_overwrite else F.coalesce(f"__{c}", c)

    return met.select(*(pick(c).alias(c) for c in old.columns))


def merge(new: DataFrame, path: str, keys: list[str], nulls_overwrite: bool = False, buckets: int = BUCKETS) -> int:
    """``new`` put into the table at ``path`` by key: the version that it becomes. A table that isn't there begins.

    New values win, nulls only with ``nulls_overwrite``. ``buckets`` counts for a table's first merge.
    """
    spark = new.sparkSession
    found = manifest(spark, path)
    if found is None:
        found = {"version": 0, "keys": keys, "count": buckets, "schema": new.schema.jsonValue(), "buckets": {}}
    if found["keys"] != keys:
        raise ValueError(f"{path} is keyed by {found['keys']}, not by {keys}")
    schema = StructType.fromJson(found["schema"])
    # hashes depend on the type: keys are those of the table
    own = new.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in new.columns})
    place = _bucket(keys, found["count"])
    touched = sorted(r[0] for r in own.select(place).distinct().collect())  # at most the number of buckets
    held = [found["buckets"][str(k)] for k in touched if str(k) in found["buckets"]]
    rows = merged(_frame(spark, path, found, held), own, keys, nulls_overwrite)
    fresh = _write(spark, path, rows.select("*", place), found["count"], touched)
    kept = {k: f for k, f in found["buckets"].items() if int(k) not in touched}
    following = found | {"version": found["version"] + 1, "buckets": kept | fresh}
    _commit(spark, path, following["version"], following)
    return following["version"]


def merge_pairs(new: DataFrame, path: str, event: str, a: str, b: str, buckets: int = BUCKETS) -> int:
    """Like merge(), by event and pair in either order: the order of sides that is already held stays.

    The table holds the pair's key beside its columns, as ``__lo`` and ``__hi``.
    """
    spark = new.sparkSession
    keyed = new.withColumns({"__lo": F.least(a, b), "__hi": F.greatest(a, b)})
    keys = [event, "__lo", "__hi"]
    found = manifest(spark, path)
    if found is not None:
        place = _bucket(keys, found["count"])
        schema = StructType.fromJson(found["schema"])
        own = keyed.withColumns({k: F.col(k).cast(schema[k].dataType) for k in keys})
        touched = sorted(r[0] for r in own.select(place).distinct().collect())
        held = _frame(spark, path, found, [found["buckets"][str(k)] for k in touched if str(k) in found["buckets"]])
        sides = held.select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b"))
        keyed = keyed.join(sides, keys, "left").withColumns({a: F.coalesce("__a", a), b: F.coalesce("__b", b)}).drop("__a", "__b")
    return merge(keyed, path, keys, buckets=buckets)


def pairs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table of merge_pairs() without its key columns."""
    return read(spark, path, version).drop("__lo", "__hi")


def export_sorted(spark: SparkSession, path: str, target: str, by: list[str]) -> str:
    """The latest version as CSV in the order of ``by``, in a folder of its own under ``target`` that is named once complete."""
    found = manifest(spark, path)
    name = f"{target}/v{found['version']:012d}"
    fs, done = _at(spark, name)
    if not fs.exists(done):
        _, fresh = _at(spark, f"{target}/.{uuid.uuid4().hex}")
        rows = read(spark, path, found["version"])
        rows.orderBy(*by).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(fresh.toString())
        fs.rename(fresh, done)
    return name


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes the folders that none of the last ``keep`` versions names, and older manifests: how many went.

    Not to be run while a merge is under way, as that one's folders aren't named yet.
    """
    held = versions(spark, path)
    stay = {f for v in held[-keep:] for f in manifest(spark, path, v)["buckets"].values()}
    fs, data = _at(spark, f"{path}/data")
    gone = 0
    for version in held[:-keep]:
        fs.delete(_at(spark, f"{path}/manifests/v{version:012d}.json")[1], False)
    for write in fs.listStatus(data) if fs.exists(data) else []:
        name = write.getPath().getName()
        for part in fs.listStatus(write.getPath()):
            folder = f"data/{name}/{part.getPath().getName()}"
            if part.isDirectory() and folder not in stay:
                fs.delete(part.getPath(), True)
                gone += 1
        if not any(f.startswith(f"data/{name}/") for f in stay):
            fs.delete(write.getPath(), True)
    return gone
