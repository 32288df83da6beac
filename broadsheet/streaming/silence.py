"""Sources that fall silent, reported at their budget by event time, in batch and stream.

A source is silent when nothing of it is dated within its budget after its newest item. Both
forms first reduce items to one row per source and window (smallest and greatest time), so a
source's rows are as many as the windows it fills, however many items it has. A window is no
longer than any budget, so silence begins at a window's greatest time and ends at the smallest
time of a later one.

The stream hands on a window when the watermark has passed it. Per source it keeps the newest
time and a timer at the end of the budget: the timer reports a source of which nothing comes
any more, and so does the first window behind a gap. The batch form sees the same windows and
gives the same rows. Items dated in the future, without a date or without a source are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

REPORT = "source STRING, latest TIMESTAMP, stale_at TIMESTAMP"


def _dated(items: DataFrame, budget: timedelta, every: timedelta) -> DataFrame:
    if every > budget:
        raise ValueError("a window must not be longer than the budget")
    return items.where((F.col("published_at") <= F.current_timestamp()) & F.col("source").isNotNull())


def _windows(items: DataFrame, every: timedelta) -> DataFrame:
    """(w, source, first, latest) per source and window that holds items of it."""
    return items.groupBy(F.window("published_at", f"{every.total_seconds()} seconds").alias("w"), "source").agg(
        F.min("published_at").alias("first"), F.max("published_at").alias("latest")
    )


def _utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


class _Silence(StatefulProcessor):
    """Newest time of a source and whether its silence is reported."""

    def __init__(self, budget: timedelta):
        self.budget = budget

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "latest TIMESTAMP, reported BOOLEAN")

    def _due(self, latest: datetime) -> int:
        """The first millisecond beyond the budget."""
        whole = (latest + self.budget - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
        return whole + 1

    def _report(self, key: tuple, latest: datetime) -> Row:
        return Row(source=key[0], latest=latest, stale_at=latest + self.budget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        latest, reported = (_utc(known[0]), known[1]) if known else (None, False)
        if known and not reported:
            self.handle.deleteTimer(self._due(latest))
        for first, newest in sorted((_utc(r.first), _utc(r.latest)) for r in rows):
            if latest is not None and first - latest > self.budget and not reported:
                yield self._report(key, latest)
            if latest is None or newest > latest:
                latest, reported = newest, False
        self.state.update((latest, reported))
        if not reported:
            self.handle.registerTimer(self._due(latest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        latest, reported = self.state.get()
        latest = _utc(latest)
        if not reported and self._due(latest) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((latest, True))
            yield self._report(key, latest)

    def close(self) -> None:
        pass


def silent_stream(items: DataFrame, budget: timedelta, every: timedelta = timedelta(minutes=10), delay: timedelta = timedelta(hours=1)) -> DataFrame:
    """(source, latest, stale_at) as each silence is noticed; ``delay`` is how late items come."""
    dated = _dated(items, budget, every).withWatermark("published_at", f"{delay.total_seconds()} seconds")
    finished = _windows(dated, every).select(F.window_time("w").alias("at"), "source", "first", "latest")
    return finished.groupBy("source").transformWithState(
        _Silence(budget), outputStructType=REPORT, outputMode="Append", timeMode="EventTime"
    )


def silent_batch(items: DataFrame, budget: timedelta, every: timedelta = timedelta(minutes=10), delay: timedelta = timedelta(hours=1)) -> DataFrame:
    """The same rows from a table, up to where a stream's watermark would stand."""
    dated = _dated(items, budget, every)
    length = F.make_dt_interval(secs=F.lit(budget.total_seconds()))
    reach = dated.agg((F.max("published_at") - F.make_dt_interval(secs=F.lit(delay.total_seconds()))).alias("reach"))
    windows = _windows(dated, every).withColumn("reach", reach.scalar())
    # A stream does not see windows that its watermark has not passed.
    finished = windows.where(F.col("w.end") <= F.col("reach"))
    following = F.lead("first").over(Window.partitionBy("source").orderBy("first"))
    return (
        finished.withColumn("next", F.coalesce(following, F.col("reach")))
        .where(F.col("next") > F.col("latest") + length)
        .select("source", "latest", (F.col("latest") + length).alias("stale_at"))
    )
