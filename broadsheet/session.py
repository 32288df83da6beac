"""Session settings, shared-folder materialisation and small dimension tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import broadsheet

# Functions for Python workers travel with their code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(broadsheet)

#: Settings every job relies on. Broadcast decisions stay with the optimizer, which
#: checks the size of a side before it ships it; skewed joins are split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work is heavy per byte: keep small shuffles spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a batch for Python holds, on either side, however long the texts are.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # State of streams lies on disk, with timers, and not on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Counting its rows would look up each key once more.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def build_session(
    master: str | None = None,
    app: str = "broadsheet",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the library's settings; the caller's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting a folder below the warehouse is used, which the session's tasks
    share as well.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work/{context.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    The table survives the loss of any executor, is column-pruned by later reads, and
    its file sizes let the optimizer decide joins on measured sizes.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dimension(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Configuration rows as a local relation with an exactly known size.

    No broadcast hint: the optimizer sees the real size and broadcasts only below its
    threshold.
    """
    fields = [f.name for f in schema.fields]
    data = [{name: row.get(name) for name in fields} for row in rows]
    table = pa.Table.from_pylist(data, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)

