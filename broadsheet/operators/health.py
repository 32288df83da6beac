"""Source health, ages, failure reasons and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.times import DEFAULT_STALE_AFTER_DAYS, age_seconds
from broadsheet.operators.topk import top_k

DAY = 86_400


def stale_sources(outcomes: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Sources that answered but whose content looks dead, with a message.

    Failed sources carry their own warning already and are left out.
    """
    budget = F.coalesce("stale_after_days", F.lit(DEFAULT_STALE_AFTER_DAYS))
    age = age_seconds(now, F.col("latest_published_at")) / DAY
    empty = F.col("n_items") == 0
    finding = F.when(empty, "empty").when(F.col("age_days") > F.col("budget"), "stale")
    name = F.concat(F.lit('source "'), F.col("source"), F.lit('"'))
    message = F.when(
        empty,
        F.concat(
            name,
            F.lit(
                " returned 0 items (HTTP was fine — the feed itself is empty or unparseable)"
            ),
        ),
    ).otherwise(
        F.concat(
            name,
            F.format_string(
                " looks stale: newest item is %d days old (budget %dd)",
                F.floor(F.col("age_days") + 0.5),
                F.col("budget"),
            ),
        )
    )
    return (
        outcomes.where(F.col("error").isNull())
        .join(
            sources.select(F.col("name").alias("source"), "stale_after_days"), "source", "left"
        )
        .withColumn("budget", budget)
        .withColumn("age_days", F.when(~empty, age))
        .withColumn("finding", finding)
        .where(F.col("finding").isNotNull())
        .withColumn("message", message)
        .drop("stale_after_days")
    )


def failed_sources(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("error").isNotNull()).withColumn(
        "message", F.format_string('source "%s" failed: %s', "source", "error")
    )


def age_label(now: Column, latest: Column) -> Column:
    """Whole hours below a day, else whole days; a dash without items."""
    seconds = age_seconds(now, latest)
    hours = F.greatest(F.lit(0), F.floor(seconds / 3600 + 0.5))
    return (
        F.when(latest.isNull(), F.lit("—"))
        .when(seconds < DAY, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / DAY + 0.5).cast("string"), F.lit("d")))
    )


def top_reasons(failures: DataFrame, keys: list[str], keep: int = 3) -> DataFrame:
    """The most frequent messages; equal counts in order of first appearance (``pos``)."""
    counted = failures.groupBy(*keys, "message").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )
    return top_k(counted, keys, [F.desc("n"), F.asc("first_pos")], keep)


def reason_warnings(reasons: DataFrame, prefix: str) -> DataFrame:
    return reasons.withColumn(
        "warning",
        F.format_string(
            f"{prefix}: %d item(s) fell back to the source excerpt — %s", "n", "message"
        ),
    )


def majority_failed(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Groups in which more attempts failed than succeeded."""
    return (
        attempts.groupBy(*keys)
        .agg(
            F.count_if(F.col("ok")).alias("succeeded"),
            F.count_if(~F.col("ok")).alias("failed"),
        )
        .where(F.col("failed") > F.col("succeeded"))
    )


def run_metrics(stage: str, rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per-run measures of one stage as (run_id, stage, metric, value) rows."""
    wide = rows.groupBy("run_id").agg(*[m.cast("double").alias(n) for n, m in measures.items()])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in measures]
    )
    return wide.select("run_id", F.lit(stage).alias("stage"), F.inline(pairs))
