"""The same rules on streams: ingest, micro-batch issues and source freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.sources.archive import HISTORY_DAYS, write_archive

#: How late an item may arrive and how long its id is remembered.
HORIZON = f"{HISTORY_DAYS} days"


def file_stream(spark: SparkSession, folder: str, schema: str, glob: str) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def distinct_items(items: DataFrame) -> DataFrame:
    """Each id once within the horizon.

    Items dated in the future are dropped first: they would push the watermark ahead and
    make everything else late. State holds ids for the horizon and no longer.
    """
    return (
        items.where(F.col("published_at") <= F.current_timestamp())
        .withWatermark("published_at", HORIZON)
        .dropDuplicatesWithinWatermark(["id"])
    )


def source_freshness(items: DataFrame, every: str = "1 hour") -> DataFrame:
    """Items and newest publish time per source and window; state ends with the horizon.

    Items dated in the future are dropped first, as in ``distinct_items``.
    """
    return (
        items.where(F.col("published_at") <= F.current_timestamp())
        .withWatermark("published_at", HORIZON)
        .groupBy(F.window("published_at", every).alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("n_items"), F.max("published_at").alias("latest"))
        .select(F.col("w.start").alias("window_start"), "source", "n_items", "latest")
    )


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished rows as files; exactly once through the sink's own log."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def upserts_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed aggregates under their epoch; a replayed epoch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("epoch").parquet(path)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every key of an upsert table."""
    newest = F.max_by(F.struct(*[c for c in table.columns if c not in {*keys, "epoch"}]), "epoch")
    return table.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*")


def issues_from_stream(
    items: DataFrame,
    build: Callable[[DataFrame, int], DataFrame],
    archive_path: str,
    checkpoint: str,
    secrets: list[str] | None = None,
) -> StreamingQuery:
    """Build and archive one issue per micro-batch.

    ``build`` gets the batch and its epoch and returns issue records whose slot names the
    epoch, so a replay overwrites its own partition. The archive is written before anything
    is delivered.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        write_archive(build(batch, epoch), archive_path, secrets)

    return (
        items.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
