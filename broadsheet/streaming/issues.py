"""Issues from a stream by the whole batch plan: the archive that one batch would give.

The stream remembers ids for the horizon, so an item that is sent again goes no further. What is
new is landed by epoch and date of its issue. Then each issue from the earliest touched date on
is built again from everything landed for it, against the archive before that date, and
committed as one version. So items may come in any files and batches, late ones included: a
late item changes its own issue, and later issues see the changed history. An epoch that is
run again lands in its own place and gives the same issues.

Days older than the horizon are late for the stream, which drops them; so no batch touches more
days than the horizon has, however long the archive is. Items without an id or a date, or dated
in the future, are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.functions.times import local_date
from broadsheet.operators.dedupe import TITLE_SIMILARITY
from broadsheet.plans.issue import Run, build_issue
from broadsheet.sources.versions import commit_issues, read_committed
from broadsheet.streaming.jobs import distinct_items


@dataclass(frozen=True)
class Paths:
    """Where a stream of issues keeps what it has landed, its archive and its progress."""

    root: str

    @property
    def landed(self) -> str:
        return f"{self.root}/landed"

    @property
    def archive(self) -> str:
        return f"{self.root}/archive"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"


@dataclass(frozen=True)
class Plan:
    """How issues are built. ``date`` gives an item's issue from its publish time: the last day
    that the issue covers, by default the day itself."""

    sections: list[dict]
    sources: list[dict]
    zone: str = "UTC"
    lookback_hours: int = 24
    threshold: float = TITLE_SIMILARITY
    schedule_id: str = "stream"
    date: Callable[[Column], Column] | None = None

    def issue_date(self, published: Column) -> Column:
        if self.date is not None:
            return self.date(published)
        return local_date(published, F.lit(self.zone))

    def record(self, items: DataFrame, date: str, archive: DataFrame) -> DataFrame:
        """The issue of a date from its items and the archive before it."""
        spark = items.sparkSession
        end = F.to_utc_timestamp(F.lit(f"{date} 23:59:59"), self.zone)
        now = spark.range(1).select(F.date_format(end, "yyyy-MM-dd HH:mm:ss")).first()[0]
        run = Run(date, now, self.zone, self.lookback_hours, self.schedule_id)
        before = archive.where(F.col("date") < date)
        return build_issue(items, run, self.sections, self.sources, before, self.threshold).record


def build_dates(items: DataFrame, plan: Plan, archive: str, first: str | None = None) -> list[str]:
    """Build and commit the issues of ``items`` from ``first`` on, oldest first; each sees the
    ones before it. Returns their dates."""
    spark = items.sparkSession
    dated = items.withColumn("issue_date", plan.issue_date(F.col("published_at")))
    if first is not None:
        dated = dated.where(F.col("issue_date") >= first)
    # One per day since ``first``.
    dates = sorted(r[0] for r in dated.select("issue_date").distinct().collect() if r[0])
    for date in dates:
        mine = dated.where(F.col("issue_date") == date).drop("issue_date")
        record = plan.record(mine, date, read_committed(spark, archive))
        own = spark.range(1).select(F.lit(date).alias("date"), F.lit(None).cast("string").alias("slot"))
        commit_issues(record, archive, remove=own)
    return dates


def stream_issues(items: DataFrame, plan: Plan, paths: Paths) -> StreamingQuery:
    """Start building issues from a stream of items (id, title, url, source, published_at, score,
    excerpt, item_pos); ends when everything that is there has been read."""
    columns = items.columns
    schema = items.schema

    def run(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        folder = f"{paths.landed}/epoch={epoch}"
        dated = batch.withColumn("landed_date", plan.issue_date(F.col("published_at")))
        dated.write.mode("overwrite").partitionBy("landed_date").parquet(folder)
        landed = spark.read.schema(schema.add("landed_date", "string") if "landed_date" not in schema.names else schema)
        touched = landed.parquet(folder).agg(F.min("landed_date")).first()[0]
        if touched is None:
            return
        whole = landed.option("basePath", paths.landed).parquet(paths.landed)
        # Dates before the touched ones are not read: they are folders.
        build_dates(whole.where(F.col("landed_date") >= touched).select(*columns), plan, paths.archive, touched)

    known = distinct_items(items.where(F.col("id").isNotNull() & F.col("published_at").isNotNull()))
    return (
        known.writeStream.foreachBatch(run)
        .option("checkpointLocation", paths.progress)
        .trigger(availableNow=True)
        .start()
    )
