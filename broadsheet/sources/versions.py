"""The issue archive as versions: a commit appears whole or not at all.

``<path>/data/version=<id>/year=.../month=.../date=...`` holds what commits wrote, the slots of
a date together, so that folders and files grow with the dates and the bytes and not with the issues;
``<path>/manifests/<number>`` the list of the issues that count and the version of each, as
a small table. A commit writes its issues under a fresh version, writes the next manifest (the
last one without the dates and slots it replaces, and its own) beside the others and renames
it to the next number. The rename is the commit: a job that ends before it leaves the old issues
as they were, and readers never see a part of one. Of two commits at a time the slower one
finds its number taken and makes its manifest again from the newer one.

A reader takes the manifest with the greatest number. ``expire`` deletes older manifests and the
versions that none of the others names. It needs the grace to be longer than any commit or read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.redact import redact_rows
from broadsheet.schema import ISSUE
from broadsheet.session import dimension

_DAYS = T.StructType([T.StructField(name, T.StringType()) for name in ("version", "year", "month")])
MANIFEST = T.StructType([T.StructField(name, T.StringType()) for name in ("date", "slot", "version")])
#: How often a commit starts again behind other commits.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other commits came first, time and again."""


def _files(spark: SparkSession, path: str):
    """The path's store, and a function from names to its paths."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _listed(spark: SparkSession, path: str) -> list:
    files, place = _files(spark, path)
    return list(files.listStatus(place(path))) if files.exists(place(path)) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are committed, ascending."""
    names = (status.getPath().getName() for status in _listed(spark, f"{path}/manifests"))
    return sorted(int(name) for name in names if name.isdigit())


def _publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename ``staged`` to ``target``; false if somebody else's ``target`` is there."""
    jvm = spark.sparkContext._jvm
    names = jvm.org.apache.hadoop.fs
    context = names.FileContext.getFileContext(names.Path(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(names.Path(staged), names.Path(target), options)
    except Exception as error:  # noqa: BLE001 - the store's own exceptions come as one kind
        if "FileAlreadyExists" in str(error) or "already exists" in str(error) or "not empty" in str(error):
            return False
        raise
    return True


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(date, slot, version) of the issues that count; the last manifest unless one is named."""
    numbers = _numbers(spark, path)
    if not numbers:
        return dimension(spark, [], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{number or numbers[-1]}")


def commit_issues(issues: DataFrame, path: str, secrets: list[str] | None = None, remove: DataFrame | None = None) -> int:
    """Replace the issues of the dates and slots in ``issues``, all at once; returns the number
    of the manifest. Every string is redacted first; an issue without items is not written. Dates
    and slots in ``remove`` leave the archive in the same commit."""
    spark = issues.sparkSession
    version = uuid.uuid4().hex
    dated = (
        redact_rows(issues.where(F.size("items") > 0), secrets)
        .withColumn("year", F.substring("date", 1, 4))
        .withColumn("month", F.substring("date", 6, 2))
        # An empty slot is none.
        .withColumn("slot", F.nullif("slot", F.lit("")))
    )
    folder = f"{path}/data/version={version}"
    days = ["year", "month", "date"]
    # A date of many issues is written by several tasks.
    dated.hint("rebalance", *map(F.col, days)).write.partitionBy(*days).parquet(folder)
    written = spark.read.schema("item_count INT, year STRING, month STRING, date STRING, slot STRING").parquet(folder)
    new = written.select("date", "slot").distinct()
    gone = new if remove is None else new.unionByName(remove.select("date", "slot")).distinct()
    for _ in range(ATTEMPTS):
        number = (_numbers(spark, path) or [0])[-1]
        old = manifest(spark, path, number or None).alias("old")
        same = (F.col("old.date") == F.col("gone.date")) & F.col("old.slot").eqNullSafe(F.col("gone.slot"))
        kept = old.join(gone.alias("gone"), same, "left_anti").select("date", "slot", "version")
        staged = f"{path}/manifests/_staged-{uuid.uuid4().hex}"
        kept.unionByName(new.withColumn("version", F.lit(version))).coalesce(1).write.parquet(staged)
        if _publish(spark, staged, f"{path}/manifests/{number + 1}"):
            return number + 1
    raise Conflict(f"{path}: other commits came first {ATTEMPTS} times")


def read_committed(spark: SparkSession, path: str, number: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """The issues that the manifest names, or those of it in ``live``. Their dates prune the folders that are read."""
    numbers = _numbers(spark, path)
    schema = T.StructType(ISSUE.fields + _DAYS.fields)
    if not numbers:
        return dimension(spark, [], schema).drop("version")
    data = spark.read.schema(schema).parquet(f"{path}/data").alias("data")
    live = (manifest(spark, path, number) if live is None else live).alias("live")
    same = (
        (F.col("data.version") == F.col("live.version"))
        & (F.col("data.date") == F.col("live.date"))
        & F.col("data.slot").eqNullSafe(F.col("live.slot"))
    )
    return data.join(live, same, "left_semi").drop("version")


def expire(spark: SparkSession, path: str, keep: int = 2, grace_seconds: float = 86_400) -> int:
    """Delete all but the last ``keep`` manifests, and versions (with what is derived from them)
    and staged folders that are older than the grace and named by none of the others; returns how
    many versions went."""
    if keep < 1:
        raise ValueError("the last manifest must stay")
    files, place = _files(spark, path)
    before = (time.time() - grace_seconds) * 1000
    numbers = _numbers(spark, path)
    named: set[str] = set()
    for number in numbers[-keep:]:
        # As many as there are commits whose issues still count.
        named |= {r.version for r in manifest(spark, path, number).select("version").distinct().collect()}
    for status in _listed(spark, f"{path}/manifests"):
        name = status.getPath().getName()
        old = name.isdigit() and int(name) in numbers[:-keep]
        if (old or name.startswith("_staged-")) and status.getModificationTime() < before:
            files.delete(status.getPath(), True)
    gone = 0
    for table in _listed(spark, path):
        folder = table.getPath().getName()
        for status in _listed(spark, f"{path}/{folder}") if folder != "manifests" else []:
            version = status.getPath().getName().removeprefix("version=")
            if version not in named and status.getModificationTime() < before:
                gone += bool(files.delete(status.getPath(), True)) and folder == "data"
    return gone
