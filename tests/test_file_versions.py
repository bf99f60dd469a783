"""Versions that share files: what a delete leaves alone, time travel, two writers."""

import os

import pytest
from pyspark.sql import functions as F

from shiftlens.plans.scratch import fresh_path
from shiftlens.sources import file_versions as fv
from shiftlens.sources import logs

SCHEMA = "id int, name string, part int"


def _table(spark, n=60):
    root = fresh_path(spark, "versions")
    rows = spark.range(n).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"), (F.col("id") % 6).cast("int").alias("part"))
    assert fv.append_version(rows.coalesce(1), root, "part") == 0
    return root


def _ids(spark, root, version=None):
    return sorted(r.id for r in fv.read_version(spark, root, SCHEMA, version).collect())


def test_a_delete_rewrites_only_files_with_hits(spark):
    root = _table(spark)
    before = set(fv.files_of(spark, root))
    assert fv.delete_rows(spark, root, SCHEMA, (F.col("part") == 2) & (F.col("id") < 30), "part") == 1
    after = set(fv.files_of(spark, root))
    assert {p.split("/")[2] for p in before - after} == {"part=2"} and len(before & after) == 5
    assert _ids(spark, root) == [i for i in range(60) if i % 6 != 2 or i >= 30]
    assert _ids(spark, root, 0) == list(range(60)), "the version before is as it was"


def test_appends_nulls_and_no_hits(spark):
    root = _table(spark)
    more = spark.createDataFrame([(100, None, 0), (101, "n9", 9), (102, "n1", None)], SCHEMA)
    assert fv.append_version(more, root, "part") == 1
    assert fv.delete_rows(spark, root, SCHEMA, F.col("name") == "none such", "part") == 1
    assert fv.delete_rows(spark, root, SCHEMA, F.col("name") == "n9", "part") == 2
    assert _ids(spark, root) == [*range(60), 100, 102] and _ids(spark, root, 1) == [*range(60), 100, 101, 102]
    assert fv.delete_rows(spark, root, SCHEMA, F.lit(True), "part") == 3 and _ids(spark, root) == []
    assert fv.append_version(more, root, "part") == 4 and _ids(spark, root) == [100, 101, 102]


def test_partitions_with_special_signs(spark):
    root, kinds = fresh_path(spark, "versions"), "id int, part string"
    names = ["a b=c", "50%", "x/y", "é", "plain", None]
    rows = spark.createDataFrame([(i, names[i % 6]) for i in range(30)], kinds).coalesce(1)
    fv.append_version(rows, root, "part")
    for name in names[:4]:
        fv.delete_rows(spark, root, kinds, (F.col("part") == name) & (F.col("id") > 6), "part")
    left = sorted((r.id, r.part) for r in fv.read_version(spark, root, kinds).collect())
    assert left == [(i, names[i % 6]) for i in range(30) if i <= 6 or i % 6 > 3]


def test_of_two_writers_one_fails(spark, monkeypatch):
    root = _table(spark)
    monkeypatch.setattr(fv, "versions", lambda *a, seen=fv.versions(spark, root): seen)
    fv.append_version(spark.createDataFrame([(200, "a", 1)], SCHEMA), root, "part")
    with pytest.raises(RuntimeError, match="meanwhile"):
        fv.append_version(spark.createDataFrame([(201, "b", 1)], SCHEMA), root, "part")
    monkeypatch.undo()
    assert _ids(spark, root)[-1] == 200 and fv.versions(spark, root) == [0, 1]


def test_old_versions_are_dropped_with_their_own_files(spark):
    root = _table(spark)
    fv.delete_rows(spark, root, SCHEMA, F.col("part") == 1, "part")
    left = _ids(spark, root)
    fv.drop_versions(spark, root)
    assert fv.versions(spark, root) == [1] and _ids(spark, root) == left
    with pytest.raises(FileNotFoundError):
        fv.read_version(spark, root, SCHEMA, 0)
    assert sum(f.startswith("part-") for _, _, files in os.walk(f"{root}/data") for f in files) == 5


def test_deleting_one_user_leaves_the_other_users_files(spark):
    root = fresh_path(spark, "log")
    rows = [(f"q{i}", "r", "t", "x", f"U{i % 40}", f"P{i % 3}", None) for i in range(400)]
    log = spark.createDataFrame(rows, ", ".join(logs.LOG_SCHEMA.split(", ")[:-1]))
    logs.append_log_version(log, root)
    before = set(fv.files_of(spark, root))
    logs.delete_user_plant(spark, root, "U7", "P1")
    after = set(fv.files_of(spark, root))
    assert len(before - after) == 1 and len(before) > 15
    assert {r.query_id for r in logs.read_log_version(spark, root).collect()} == {r[0] for r in rows if (r[4], r[5]) != ("U7", "P1")}
