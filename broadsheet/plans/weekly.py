"""The weekly review as an issue of its own, from committed issues alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import responses, views
from broadsheet.schema import SECTION
from broadsheet.session import dimension, materialize
from broadsheet.sources import versions
from broadsheet.sources.archive import WEEKLY_SLOT, build_issues

#: Days that a review looks back on, its last day included, and items it keeps per section.
DAYS, PER_SECTION = 7, 5


@dataclass(frozen=True)
class Weekly:
    """What one review leaves: its record (no row for a week without items) and its window."""

    record: DataFrame
    window: DataFrame


def run_weekly(
    spark: SparkSession,
    path: str,
    end: str,
    now: str,
    sections: list[dict],
    days: int = DAYS,
    limit: int = PER_SECTION,
    digest: Callable[[DataFrame], DataFrame] | None = None,
    zone: str = "UTC",
    config_hash: str = "",
) -> Weekly:
    """Review the committed issues of the ``days`` days that end on ``end``, and commit the
    review under the slot of reviews of that day.

    Items keep the scores and summaries they were archived with. Sections come in their own
    order; those that are disabled, unknown or empty are left out. ``digest`` answers one request
    per review (see ``responses.digests``); a failed one becomes a warning. A second run replaces
    the first one's review and nothing else. Earlier reviews are no input.
    """
    archive = versions.read_committed(spark, path)
    enabled = sorted((s for s in sections if s["enabled"]), key=lambda s: s["section_pos"])
    names = [s["id"] for s in enabled]
    order = dimension(spark, enabled, SECTION).select(F.col("id").alias("section"), "section_pos")
    picked = views.weekly_review(archive, end, days, names, limit).join(order, "section")
    # At most ``limit`` rows a section.
    lineup = materialize(
        picked.withColumns({"run_id": F.lit(f"{end}.{WEEKLY_SLOT}"), "rank_in_section": F.col("rank") - 1}).drop("rank"), "review"
    )
    runs = spark.range(1).select(
        F.lit(f"{end}.{WEEKLY_SLOT}").alias("run_id"),
        F.lit(end).alias("date"),
        F.lit(WEEKLY_SLOT).alias("slot"),
        F.lit(WEEKLY_SLOT).alias("schedule_id"),
        F.lit(now).cast("timestamp").alias("generated_at"),
        F.lit(config_hash).alias("config_hash"),
        F.lit(zone).alias("timezone"),
        F.lit(days * 24.0).alias("lookback_hours"),
    )
    warnings = None
    if digest is not None:
        made = responses.digests(lineup, digest)
        runs = runs.join(made.select("run_id", "digest"), "run_id", "left")
        warnings = made.where(F.col("warning").isNotNull()).select("run_id", "warning")
    record = materialize(build_issues(lineup, runs, warnings), "weekly")
    versions.commit_issues(record, path)
    return Weekly(record, views.weekly_window(archive, end, days, names))
