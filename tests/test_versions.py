"""Versioned tables against a plain dictionary of rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions

SCHEMA = "month string, id int, v string"


def rows(table):
    return sorted(((r["month"] or "", r["id"] or 0, r["v"] or "") for r in table.collect()))


def test_replace_delete_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    versions.replace_parts(make([("2024-01", 1, "a"), ("2024-02", 2, "b"), (None, 3, "c"), ("x/y=z", 4, "d")]), path, "month")
    old = versions.read_version(spark, path)
    assert rows(old) == [("", 3, "c"), ("2024-01", 1, "a"), ("2024-02", 2, "b"), ("x/y=z", 4, "d")]
    assert rows(versions.read_version(spark, path, ["x/y=z", None])) == [("", 3, "c"), ("x/y=z", 4, "d")]
    versions.replace_parts(make([("2024-01", 9, "n"), ("2024-02", 8, "not named")]), path, "month", ["2024-01", None])
    assert rows(versions.read_version(spark, path)) == [("2024-01", 9, "n"), ("2024-02", 2, "b"), ("x/y=z", 4, "d")]
    assert rows(old) == [("", 3, "c"), ("2024-01", 1, "a"), ("2024-02", 2, "b"), ("x/y=z", 4, "d")]  # its own files
    versions.upsert_rows(make([("2024-03", 2, "moved"), ("2024-01", None, "new"), ("2024-01", None, "twin")]), path, "month", ["id"])
    assert rows(versions.read_version(spark, path)) == [
        ("2024-01", 0, "new"), ("2024-01", 0, "twin"), ("2024-01", 9, "n"), ("2024-03", 2, "moved"), ("x/y=z", 4, "d")]
    number = versions.delete_rows(spark, path, "month", F.col("id") > 3)
    assert rows(versions.read_version(spark, path)) == [("2024-01", 0, "new"), ("2024-01", 0, "twin"), ("2024-03", 2, "moved")]
    assert versions.delete_rows(spark, path, "month", F.col("id") > 3) == number  # nothing to do, no new version
    versions.forget_versions(spark, path, 1)
    assert rows(versions.read_version(spark, path)) == [("2024-01", 0, "new"), ("2024-01", 0, "twin"), ("2024-03", 2, "moved")]
    versions.replace_parts(make([]), path, "month")
    empty = versions.read_version(spark, path)
    assert rows(empty) == [] and empty.columns == ["month", "id", "v"]


def test_failing_change_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "table")
    good = spark.createDataFrame([("2024-01", i, "a") for i in range(20)], SCHEMA)
    versions.replace_parts(good, path, "month")
    broken = good.withColumn("v", F.when(F.col("id") == 19, F.raise_error(F.lit("lost"))).otherwise("half"))
    with pytest.raises(Exception, match="lost"):
        versions.replace_parts(broken, path, "month", ["2024-01"])
    assert rows(versions.read_version(spark, path)) == rows(good) and versions.latest(spark, path) == 0
    manifest = versions._manifest(spark, path, 0)
    assert versions._publish(spark, path, 0, manifest) == 1
    with pytest.raises(versions.VersionConflict):  # a writer that began from version 0 too
        versions._publish(spark, path, 0, manifest)
    assert rows(versions.read_version(spark, path)) == rows(good)
