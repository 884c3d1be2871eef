"""Tables whose parts are replaced in place: readers see the version before a change or the one after it, never a mixture.

A table is a folder of Parquet folders, one for each part (a month, a model), and of numbered manifests that name the
parts of a version. A change writes new folders first and then moves its manifest into place under the next number,
which fails if another writer took that number. Files of a version stay until `forget_versions`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"  # names the folders; the column itself stays in the files
NULL = "__HIVE_DEFAULT_PARTITION__"  # fixed value: how Spark names the folder of nulls


class VersionConflict(RuntimeError):
    """Another writer has published since this change began."""


def _files(spark: SparkSession, path: str):
    """(file system, a function that makes its paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, path: str) -> list[str]:
    files, make = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(make(path))) if files.exists(make(path)) else []


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and n[:-5].isdigit()]


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    rows = spark.read.text(f"{path}/_manifests/{number:09d}.json", wholetext=True).collect()
    return json.loads(rows[0]["value"])


def latest(spark: SparkSession, path: str) -> int | None:
    """The number of the newest version; None if the table has none."""
    return max(_manifests(spark, path), default=None)


def _publish(spark: SparkSession, path: str, before: int | None, manifest: dict) -> int:
    """Move a manifest into place as the version after `before`; the move is the only step that readers see."""
    number = 0 if before is None else before + 1
    files, make = _files(spark, path)
    draft, place = make(f"{path}/_manifests/.{uuid.uuid4().hex}"), make(f"{path}/_manifests/{number:09d}.json")
    out = files.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.NONE
    try:
        fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(place), how)
    except Exception as error:
        files.delete(draft, False)
        if files.exists(place):
            raise VersionConflict(f"{path} has a version {number} already") from error
        raise
    return number


def _written(rows: DataFrame, path: str, by: str) -> dict[str, str]:
    """Write rows as new part folders; {part: folder}."""
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    rows.withColumn(PART, F.col(by).cast("string")).write.partitionBy(PART).parquet(f"{path}/{folder}")
    names = [n for n in _names(spark, f"{path}/{folder}") if n.startswith(f"{PART}=")]
    return {unquote(n[len(PART) + 1:]): f"{folder}/{n}" for n in names}


def _state(spark: SparkSession, path: str, by: str, schema: StructType | None = None) -> tuple[int | None, dict]:
    before = latest(spark, path)
    if before is not None:
        manifest = _manifest(spark, path, before)
        if manifest["by"] != by:
            raise ValueError(f"{path} has parts by {manifest['by']}, not {by}")
        return before, manifest
    return None, {"by": by, "schema": None if schema is None else schema.json(), "parts": {}}


def _part_name(value) -> str:
    return NULL if value is None or value == "" else str(value)


def read_version(
    spark: SparkSession, path: str, parts: Sequence[str | None] | None = None, version: int | None = None
) -> DataFrame:
    """A version of the table (the newest if None), whole or the named parts only; other folders are not listed.

    The frame stays on its version's files, whatever is published later. A table without rows keeps its columns.
    """
    number = latest(spark, path) if version is None else version
    if number is None:
        raise ValueError(f"{path} has no version")
    manifest = _manifest(spark, path, number)
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    asked = None if parts is None else {_part_name(p) for p in parts}
    folders = [f for part, f in sorted(manifest["parts"].items()) if asked is None or part in asked]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}" for folder in folders))


def replace_parts(table: DataFrame, path: str, by: str, parts: Sequence[str | None] | None = None) -> int:
    """Publish `table` as the whole new content (parts None), or as that of the named parts, also where it has no rows.

    Rows of other parts than the named ones are not written. Null and the empty string name one part. Columns follow
    the first version; a later table must have them all, more are left out. Returns the version's number.
    """
    spark = table.sparkSession
    before, manifest = _state(spark, path, by, table.schema)
    rows = table.select([f.name for f in StructType.fromJson(json.loads(manifest["schema"])).fields])
    if parts is None:
        manifest["parts"] = {}
    else:
        names = {_part_name(p) for p in parts}
        rows = rows.where(F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NULL)).isin(*names))
        manifest["parts"] = {p: f for p, f in manifest["parts"].items() if p not in names}
    manifest["parts"] |= _written(rows, path, by)
    return _publish(spark, path, before, manifest)


def _rewritten(spark: SparkSession, path: str, by: str, touched: DataFrame, change) -> int:
    """Publish the parts that `touched` names (column `by`) as `change` makes them of their rows; other folders stay as they are."""
    before, manifest = _state(spark, path, by)
    if before is None:
        raise ValueError(f"{path} has no version")
    parts = sorted({_part_name(r[0]) for r in touched.select(F.col(by).cast("string")).distinct().collect()})
    if not parts:
        return before
    rows = change(read_version(spark, path, parts, before))
    manifest["parts"] = {p: f for p, f in manifest["parts"].items() if p not in parts} | _written(rows, path, by)
    return _publish(spark, path, before, manifest)


def delete_rows(spark: SparkSession, path: str, by: str, condition: Column) -> int:
    """Publish the table without the rows for which the condition is true; parts without such a row aren't rewritten."""
    found = read_version(spark, path).where(condition)
    return _rewritten(spark, path, by, found, lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))


def upsert_rows(rows: DataFrame, path: str, by: str, keys: Sequence[str]) -> int:
    """Publish the table with `rows` in place of all rows of equal keys (null equals null), wherever these were.

    Rows of `rows` that share keys all stay. Only parts that lose or gain a row are rewritten.
    """
    spark = rows.sparkSession
    now = read_version(spark, path)
    new = rows.select(now.columns)
    given = new.select(*(F.col(k).alias(f"_new_{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_new_{i}")) for i, k in enumerate(keys)]
    touched = now.join(given, same, "left_semi").select(by).unionByName(new.select(by))
    return _rewritten(spark, path, by, touched, lambda old: old.join(given, same, "left_anti").unionByName(new))


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest versions, and the folders that none of these names.

    Not while a change runs, whose folders no manifest names yet, nor while older versions are read.
    """
    numbers = sorted(_manifests(spark, path))[-max(keep, 1):]
    used = {folder.split("/")[0]: set() for n in numbers for folder in _manifest(spark, path, n)["parts"].values()}
    for n in numbers:
        for folder in _manifest(spark, path, n)["parts"].values():
            used[folder.split("/")[0]].add(folder)
    files, make = _files(spark, path)
    for n in set(_manifests(spark, path)) - set(numbers):
        files.delete(make(f"{path}/_manifests/{n:09d}.json"), False)
    for name in (n for n in _names(spark, path) if n.startswith("data-")):
        if name not in used:
            files.delete(make(f"{path}/{name}"), True)
            continue
        for part in (p for p in _names(spark, f"{path}/{name}") if f"{name}/{p}" not in used[name] and p.startswith(PART)):
            files.delete(make(f"{path}/{name}/{part}"), True)
