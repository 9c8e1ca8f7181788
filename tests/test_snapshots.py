"""Merges into tables of snapshots: by key, by touched bucket, and whatever fails on the way."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from boutlens.sinks import snapshots


def people(spark, rows):
    return spark.createDataFrame(rows, "name string, source string, height double")


def held(spark, path, version=None):
    return sorted(map(tuple, snapshots.read(spark, path, version).collect()), key=str)


def test_merges_by_key(spark, tmp_path):
    path, keys = str(tmp_path / "fighters"), ["name", "source"]
    assert snapshots.merge(people(spark, [("a", "x", 70.0), ("b", "x", 60.0), (None, "x", 1.0)]), path, keys) == 1
    assert snapshots.merge(people(spark, [("a", "x", None), ("c", "x", 50.0), (None, "x", 2.0)]), path, keys) == 2
    assert held(spark, path) == sorted([("a", "x", 70.0), ("b", "x", 60.0), ("c", "x", 50.0), (None, "x", 2.0)], key=str)
    snapshots.merge(people(spark, [("a", "x", None)]), path, keys, nulls_overwrite=True)
    assert ("a", "x", None) in held(spark, path) and ("a", "x", 70.0) in held(spark, path, 2) and len(held(spark, path, 1)) == 3
    # fewer, more and differently typed columns
    snapshots.merge(spark.createDataFrame([("b", "x", "further")], "name string, source string, extra string"), path, keys)
    assert ("b", "x", 60.0) in held(spark, path)
    with pytest.raises(ValueError, match="is keyed by"):
        snapshots.merge(people(spark, [("a", "x", 1.0)]), path, ["name"])
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, path, 99)
    with pytest.raises(ValueError, match="no table"):
        snapshots.read(spark, str(tmp_path / "none"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.merge(spark.range(500).select("id", F.lit(0).alias("v")), path, ["id"], buckets=16)
    before = snapshots.manifest(spark, path)["buckets"]
    files = {f: sorted(os.listdir(f"{path}/{f}")) for f in before.values()}
    assert len(before) == 16
    snapshots.merge(spark.range(3).select("id", F.lit(1).alias("v")), path, ["id"])
    after = snapshots.manifest(spark, path)["buckets"]
    changed = {k for k in after if after[k] != before[k]}
    assert 1 <= len(changed) <= 3 and all(sorted(os.listdir(f"{path}/{f}")) == files[f] for f in before.values())
    assert snapshots.read(spark, path).agg(F.count("*"), F.sum("v")).first() == (500, 3)
    # the key's type is the table's: an int finds the bucket of the long
    snapshots.merge(spark.range(3).select(F.col("id").cast("int").alias("id"), F.lit(2).alias("v")), path, ["id"])
    assert snapshots.read(spark, path).agg(F.count("*"), F.sum("v")).first() == (500, 6)


@pytest.mark.parametrize("where", ["_write", "_commit", "rename"])
def test_a_failure_leaves_the_old_table(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "t")
    snapshots.merge(people(spark, [("a", "x", 1.0)]), path, ["name", "source"])

    def broken(*args):
        if where == "rename":  # the data and the manifest are there, but not under its name
            open(f"{path}/manifests/.left", "w").write(json.dumps(args[-1]))
        raise OSError("lost")

    whole = snapshots._write
    if where == "_write":  # some files are written
        monkeypatch.setattr(snapshots, "_write", lambda *a: (whole(*a), broken())[0])
    else:
        monkeypatch.setattr(snapshots, "_commit", broken)
    with pytest.raises(OSError):
        snapshots.merge(people(spark, [("a", "x", 2.0), ("b", "y", 3.0)]), path, ["name", "source"])
    monkeypatch.undo()
    assert held(spark, path) == [("a", "x", 1.0)] and snapshots.versions(spark, path) == [1]
    assert snapshots.merge(people(spark, [("a", "x", 2.0), ("b", "y", 3.0)]), path, ["name", "source"]) == 2
    assert held(spark, path) == [("a", "x", 2.0), ("b", "y", 3.0)]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two merges from one version the second gets an error and changes nothing."""
    path = str(tmp_path / "t")
    snapshots.merge(people(spark, [("a", "x", 1.0)]), path, ["name", "source"])
    whole = snapshots._write

    def late(*args):
        monkeypatch.setattr(snapshots, "_write", whole)
        snapshots.merge(people(spark, [("b", "x", 2.0)]), path, ["name", "source"])
        return whole(*args)

    monkeypatch.setattr(snapshots, "_write", late)
    with pytest.raises(snapshots.Conflict):
        snapshots.merge(people(spark, [("c", "x", 3.0)]), path, ["name", "source"])
    assert held(spark, path) == [("a", "x", 1.0), ("b", "x", 2.0)]


def test_pairs_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "fights")
    bouts = lambda rows: spark.createDataFrame(rows, "event long, a long, b long, winner long")
    snapshots.merge_pairs(bouts([(1, 9, 3, None)]), path, "event", "a", "b")
    snapshots.merge_pairs(bouts([(1, 3, 9, 3), (2, 3, 9, 9)]), path, "event", "a", "b")
    assert {tuple(r) for r in snapshots.pairs(spark, path).collect()} == {(1, 9, 3, 3), (2, 3, 9, 9)}


def test_vacuum_and_export(spark, tmp_path):
    path, target = str(tmp_path / "t"), str(tmp_path / "csv")
    rng = random.Random(3)
    state = {}
    for _ in range(5):
        new = {rng.randrange(40): rng.random() for _ in range(12)}
        state |= new
        snapshots.merge(spark.createDataFrame(sorted(new.items()), "id long, v double"), path, ["id"], buckets=8)
    assert snapshots.versions(spark, path) == [1, 2, 3, 4, 5]
    assert snapshots.vacuum(spark, path, keep=2) > 0 and snapshots.versions(spark, path) == [4, 5]
    assert {r.id: r.v for r in snapshots.read(spark, path).collect()} == state and snapshots.read(spark, path, 4).count() > 0
    name = snapshots.export_sorted(spark, path, target, ["id"])
    assert name == snapshots.export_sorted(spark, path, target, ["id"])
    lines = [x for f in sorted(os.listdir(name)) if f.endswith(".csv") for x in open(f"{name}/{f}").read().splitlines() if x != "id,v"]
    assert [int(x.split(",")[0]) for x in lines] == sorted(state)
