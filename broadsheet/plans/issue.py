"""From raw items to an archived issue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.times import local_date
from broadsheet.operators.dedupe import TITLE_SIMILARITY, history_facts, label_drops, with_trust_key
from broadsheet.operators.filters import needed_sources
from broadsheet.operators.planning import Budget, Gate, plan_tasks
from broadsheet.operators.ranking import exclusive_lineups
from broadsheet.session import materialize
from broadsheet.sources.archive import build_issues, issue_items, read_window


@dataclass(frozen=True)
class Run:
    """One issue: when it is built, for which zone, and from how far back."""

    run_id: str
    now: str
    zone: str = "UTC"
    lookback_hours: int = 24
    schedule_id: str = "daily"
    slot: str | None = None
    config_hash: str = ""


@dataclass(frozen=True)
class Issue:
    """The stages of one issue, lazily evaluated past the deduplication."""

    labelled: DataFrame
    lineup: DataFrame
    tasks: DataFrame
    runs: DataFrame
    record: DataFrame


def config_stamp(text: Column) -> Column:
    """Twelve hex digits of the configuration's SHA-256, kept on every issue."""
    return F.substring(F.sha2(text, 256), 1, 12)


def build_issue(
    items: DataFrame,
    run: Run,
    sections: list[dict],
    sources: list[dict],
    archive: DataFrame | None = None,
    threshold: float = TITLE_SIMILARITY,
    policy: list[dict] | None = None,
    gate: Gate | None = None,
    budget: Budget | None = None,
) -> Issue:
    """Dedupe against the archive, fill the sections, plan the summaries, make the record.

    Only items of sources that some enabled section reads take part.
    """
    now = F.lit(run.now).cast("timestamp")
    read = items.where(F.col("source").isin(needed_sources(sections)))
    history = None
    if archive is not None:
        today = items.sparkSession.range(1).select(local_date(now, F.lit(run.zone))).first()[0]
        history = history_facts(issue_items(read_window(archive, today)).select("id", "title"))
        history = materialize(history, "history")
    labelled = label_drops(with_trust_key(read, sources), history, threshold).withColumn(
        "run_id", F.lit(run.run_id)
    )
    # Written, since each wave of sections reads the items that stay.
    kept = materialize(labelled.where(F.col("cause").isNull()), "fresh")
    fresh = kept.withColumn("now", now).withColumn("lookback_hours", F.lit(run.lookback_hours))
    lineup = exclusive_lineups(fresh, sections, sources)
    tasks = plan_tasks(lineup, policy or [], gate or Gate(), budget or Budget())
    runs = items.sparkSession.range(1).select(
        F.lit(run.run_id).alias("run_id"),
        local_date(now, F.lit(run.zone)).alias("date"),
        F.lit(run.slot).cast("string").alias("slot"),
        F.lit(run.schedule_id).alias("schedule_id"),
        now.alias("generated_at"),
        F.lit(run.config_hash).alias("config_hash"),
        F.lit(run.zone).alias("timezone"),
        F.lit(float(run.lookback_hours)).alias("lookback_hours"),
    )
    return Issue(labelled, lineup, tasks, runs, build_issues(lineup, runs))
