"""Tables derived from the archive's versions, kept beside them and extended commit by commit.

``<path>/<name>/version=<id>/bucket=...`` holds what was derived from one version of the data.
A version never changes, so a part is made once: for a version that has none yet, all in one
job, and put in place by a rename. Rows carry the date and slot of their issue, or lead to them;
only those that the manifest names with this version count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.schema import ISSUE
from broadsheet.sources.versions import _listed, _publish, manifest

#: Folders that the rows of a version are dealt to by their key.
BUCKETS = 256


def bucket(key: Column) -> Column:
    return F.pmod(F.crc32(key), F.lit(BUCKETS)).cast("int")


def extend(spark: SparkSession, path: str, name: str, make: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Make the parts of versions that have none; returns these versions. ``make`` gets issues
    with their version and returns rows with ``version, bucket``."""
    live = {r.version for r in manifest(spark, path).select("version").distinct().collect()}
    have = {s.getPath().getName().removeprefix("version=") for s in _listed(spark, f"{path}/{name}")}
    missing = sorted(live - have)
    if not missing:
        return []
    schema = T.StructType([*ISSUE.fields, T.StructField("version", T.StringType())])
    data = spark.read.schema(schema).parquet(f"{path}/data").where(F.col("version").isin(missing))
    staged = f"{path}/{name}-staged/{uuid.uuid4().hex}"
    rows = make(data)
    # A folder of many rows is written by several tasks.
    rows.hint("rebalance", F.col("version"), F.col("bucket")).write.partitionBy("version", "bucket").parquet(staged)
    made = {s.getPath().getName() for s in _listed(spark, staged)}
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    for version in missing:
        part = f"version={version}"
        if part not in made:  # nothing of this version has a key
            files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{staged}/{part}"))
        _publish(spark, f"{staged}/{part}", f"{path}/{name}/{part}")
    return missing


def stored(spark: SparkSession, path: str, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of all versions, of some buckets."""
    whole = f"{schema}, version STRING, bucket INT"
    if not _listed(spark, f"{path}/{name}"):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(f"{path}/{name}")
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def of_live(spark: SparkSession, path: str, rows: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Rows of live issues (``live``: those of the manifest, or some of them)."""
    rows, listed = rows.alias("rows"), (manifest(spark, path) if live is None else live).alias("live")
    same = (F.col("rows.version") == F.col("live.version")) & (F.col("rows.date") == F.col("live.date"))
    return rows.join(listed, same & F.col("rows.slot").eqNullSafe(F.col("live.slot")), "left_semi")


def read(spark: SparkSession, path: str, name: str, schema: str, buckets: list[int] | None = None, live: DataFrame | None = None) -> DataFrame:
    """Rows with the date and slot of live issues, of some buckets."""
    rows = stored(spark, path, name, f"{schema}, date STRING, slot STRING", buckets)
    return of_live(spark, path, rows, live)
