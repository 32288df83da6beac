"""A daily issue from landed payloads to the archive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.dedupe import TITLE_SIMILARITY
from broadsheet.operators.health import failed_sources, reason_warnings, run_metrics, stale_sources, top_reasons
from broadsheet.operators.normalize import first_per_source, normalize, source_outcomes
from broadsheet.operators.planning import Budget, Gate, plan_measures
from broadsheet.operators.responses import digests, merge_summaries, parse_responses, summary_failures
from broadsheet.plans.issue import Run, build_issue
from broadsheet.schema import SOURCE
from broadsheet.session import dimension, materialize
from broadsheet.sources.archive import build_issues, write_archive
from broadsheet.sources.feeds import parse_landing


@dataclass(frozen=True)
class Daily:
    """What one run leaves: its record, its source outcomes and its metrics."""

    record: DataFrame
    outcomes: DataFrame
    metrics: DataFrame


def run_daily(
    spark: SparkSession,
    landing: DataFrame,
    run: Run,
    sections: list[dict],
    sources: list[dict],
    archive: DataFrame | None = None,
    answer: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = TITLE_SIMILARITY,
    policy: list[dict] | None = None,
    gate: Gate | None = None,
    budget: Budget | None = None,
    max_chars: int = 180,
    path: str | None = None,
    digest: Callable[[DataFrame], DataFrame] | None = None,
) -> Daily:
    """Parse, normalize, limit, dedupe against the archive, select, plan, merge, archive.

    ``landing`` has ``run_id, source, fetched_at, status, body`` and may have ``body_pos``.
    ``answer`` gives the tasks' raw answers (run_id, item_id, model, prompt_version, raw, and
    perhaps error); ``digest`` introduces the issue, summaries included (see
    ``responses.digests``). Failed and stale sources, the most frequent reasons for missing
    summaries and a failed digest become the record's warnings; a failed body never fails the
    run. With a ``path`` the record is written there.
    """
    known = dimension(spark, sources, SOURCE)
    entries, errors = parse_landing(landing, known)
    items = normalize(entries, known.select(F.col("name").alias("source"), "strip_patterns"))
    limits = known.select(F.col("name").alias("source"), "fetch_limit")
    # Bodies of a source follow each other: positions go on from body to body.
    if "body_pos" in items.columns:
        items = items.withColumn("item_pos", F.struct("body_pos", "item_pos"))
    items = first_per_source(items, limits).withColumn("item_pos", F.col("arrival")).drop("arrival", "body_pos")
    items = materialize(items, "items")
    reasons = errors.groupBy("run_id", "source").agg(F.min("error").alias("error"))
    outcomes = materialize(source_outcomes(landing.select("run_id", "source").distinct(), items, reasons), "outcomes")
    now = F.lit(run.now).cast("timestamp")
    warnings = failed_sources(outcomes).select("run_id", F.col("message").alias("warning")).unionByName(
        stale_sources(outcomes, known, now).select("run_id", F.col("message").alias("warning"))
    )
    issue = build_issue(items, run, sections, sources, archive, threshold, policy, gate, budget)
    lineup, tasks = issue.lineup, materialize(issue.tasks, "tasks")
    if answer is not None:
        planned = tasks.where(F.col("decision") == "task")
        answers = materialize(answer(planned), "answers")
        parsed = parse_responses(answers, max_chars).withColumn("input_kind", F.lit("excerpt"))
        lineup = merge_summaries(lineup, parsed)
        reasons = top_reasons(summary_failures(planned, answers, parsed), ["run_id"])
        warnings = warnings.unionByName(reason_warnings(reasons, "llm").select("run_id", "warning"))
    runs = issue.runs
    if digest is not None:
        lineup = materialize(lineup, "lineup")
        made = materialize(digests(lineup, digest), "digests")
        runs = runs.join(made.select("run_id", "digest"), "run_id", "left")
        warnings = warnings.unionByName(made.where(F.col("warning").isNotNull()).select("run_id", "warning"))
    record = materialize(build_issues(lineup, runs, warnings), "record")
    if path is not None:
        write_archive(record, path)
    cause = F.col("cause")
    metrics = [
        run_metrics("fetch", outcomes, {"sources": F.count(F.lit(1)), "failed": F.count("error"), "items": F.sum("n_items")}),
        run_metrics("dedupe", issue.labelled, {"within_run": F.count_if(cause == "within"), "seen": F.count_if(cause == "seen"), "kept": F.count_if(cause.isNull())}),
        run_metrics("plan", tasks, plan_measures()),
    ]
    whole = metrics[0]
    for more in metrics[1:]:
        whole = whole.unionByName(more)
    return Daily(record, outcomes, whole)
