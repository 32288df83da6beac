"""Raw entries to items, per-source limits and source outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.times import published_at
from broadsheet.functions.urls import item_id
from broadsheet.operators.topk import places, top_k
from broadsheet.session import materialize


def normalize(
    entries: DataFrame, patterns: DataFrame | None = None, excerpt_max: int = tx.EXCERPT_MAX
) -> DataFrame:
    """Entries with texts as published become items; those without title or url go.

    ``entries`` has ``title, url, source, published (text or null), score, author,
    excerpt, run_time`` and passes its other columns through. ``patterns`` maps a source
    to its ordered boilerplate patterns.
    """
    if patterns is None:
        rows = entries.withColumn("strip_patterns", F.lit(None).cast("array<string>"))
    else:
        rows = entries.join(patterns.select("source", "strip_patterns"), "source", "left")
    strip = F.col("strip_patterns")
    named = (
        rows.withColumn("url", tx.trim_space(F.coalesce("url", F.lit(""))))
        .withColumn(
            "title",
            tx.strip_boilerplate(tx.strip_html(F.coalesce("title", F.lit(""))), strip),
        )
        .where((F.col("url") != "") & (F.col("title") != ""))
    )
    finite = ~F.isnan("score") & (F.abs("score") != float("inf"))
    return (
        named.withColumn("id", item_id(F.col("url")))
        .withColumn("published_at", published_at(F.col("published"), F.col("run_time")))
        .withColumn("score", F.when(finite, F.col("score")))
        .withColumn("author", F.nullif(tx.trim_space(F.col("author")), F.lit("")))
        .withColumn("excerpt", tx.excerpt(F.col("excerpt"), strip, excerpt_max))
        .drop("strip_patterns", "published", "run_time")
    )


def _arrivals(items: DataFrame) -> DataFrame:
    """``items`` with their 1-based place in each run and source, numbered by ranges."""
    keys = ["run_id", "source"]
    ranged = items.repartitionByRange(*keys, "item_pos").sortWithinPartitions(*keys, "item_pos")
    ranged = materialize(ranged.withColumn("_n", F.monotonically_increasing_id()), "arrivals")
    return places(ranged, "_n", keys, "arrival").drop("_n")


def first_per_source(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The first ``fetch_limit`` items of each source in payload order, with their ``arrival``;
    ``limits`` is configuration, one row a source. A source without a limit keeps all items
    and does not change how the others are cut."""
    most, free = limits.agg(F.max("fetch_limit"), F.count_if(F.col("fetch_limit").isNull())).first()
    named = items.join(limits.select("source", "fetch_limit"), "source")
    limited = named.where("fetch_limit IS NOT NULL")
    capped = top_k(limited, ["run_id", "source"], [F.asc("item_pos")], most or 0, rank="arrival")
    capped = capped.where(F.col("arrival") <= F.col("fetch_limit")).drop("fetch_limit")
    if not free:
        return capped
    whole = _arrivals(named.where("fetch_limit IS NULL").drop("fetch_limit"))
    return capped.withColumn("arrival", F.col("arrival").cast("bigint")).unionByName(whole)


def source_outcomes(
    sources: DataFrame, items: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """One row per run and source, also for sources that failed or returned nothing.

    ``sources`` lists (run_id, source) attempts; ``errors`` has (run_id, source, error). A
    failed source reports its error and no items.
    """
    counted = items.groupBy("run_id", "source").agg(
        F.count(F.lit(1)).alias("n_items"), F.max("published_at").alias("latest_published_at")
    )
    out = sources.join(counted, ["run_id", "source"], "left")
    if errors is None:
        out = out.withColumn("error", F.lit(None).cast("string"))
    else:
        out = out.join(errors, ["run_id", "source"], "left")
    healthy = F.col("error").isNull()
    return out.withColumn(
        "n_items", F.when(healthy, F.coalesce("n_items", F.lit(0))).otherwise(F.lit(0))
    ).withColumn("latest_published_at", F.when(healthy, F.col("latest_published_at")))
