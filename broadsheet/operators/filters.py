"""Which items a section may choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.schema import SECTION, SOURCE
from broadsheet.session import dimension, let

FACTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("min_score", T.DoubleType()),
    ]
)


def _haystack(title: Column, excerpt: Column) -> Column:
    return F.lower(F.concat(title, F.lit("\n"), F.coalesce(excerpt, F.lit(""))))


def matches_keyword(title: Column, excerpt: Column, keyword: Column) -> Column:
    """Literal, case-insensitive substring of the title and excerpt."""
    return F.contains(_haystack(title, excerpt), F.lower(keyword))


def matches_any(title: Column, excerpt: Column, keywords: Column) -> Column:
    """Any keyword; the text is lowered once for all of them."""
    return let(
        _haystack(title, excerpt),
        lambda text: F.exists(keywords, lambda k: F.contains(text, F.lower(k))),
    )


def within_window(at: Column, now: Column, lookback_hours: Column) -> Column:
    """Both ends included; nothing from the future."""
    since = F.unix_micros(now) - (lookback_hours * F.lit(3600_000_000)).cast("bigint")
    return at.between(F.timestamp_micros(since), now)


def meets_floor(score: Column, floor: Column) -> Column:
    """A floor above zero needs a score that reaches it."""
    return F.coalesce(floor <= 0, F.lit(True)) | F.coalesce(score >= floor, F.lit(False))


def source_facts(spark: SparkSession, sources: list[dict]) -> DataFrame:
    rows = [
        {"source": s["name"], "weight": s.get("weight", 1.0), "min_score": s.get("min_score")}
        for s in sources
    ]
    return dimension(spark, rows, FACTS)


def with_source_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Weight and score floor by source; an unknown source weighs 1."""
    return items.join(facts, "source", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(1.0))
    )


def section_bridge(spark: SparkSession, sections: list[dict]) -> DataFrame:
    """One row per section and source it reads."""
    return (
        dimension(spark, sections, SECTION)
        .withColumnRenamed("id", "section")
        .withColumn("source", F.explode("sources"))
        .drop("sources", "title", "enabled")
    )


def section_candidates(items: DataFrame, sections: list[dict], facts: DataFrame) -> DataFrame:
    """(item, section) pairs that pass source, window, floor and keywords.

    The window is tested before the join multiplies rows. Needs ``now, lookback_hours``.
    """
    bridge = section_bridge(items.sparkSession, sections)
    fresh = items.where(
        within_window(F.col("published_at"), F.col("now"), F.col("lookback_hours"))
    )
    title, excerpt = F.col("title"), F.col("excerpt")
    include, exclude = F.col("include"), F.col("exclude")
    return (
        with_source_facts(fresh, facts)
        .where(meets_floor(F.col("score"), F.col("min_score")))
        .join(bridge, "source")
        .where(~F.coalesce(matches_any(title, excerpt, exclude), F.lit(False)))
        .where(
            (F.coalesce(F.size(include), F.lit(0)) <= 0) | matches_any(title, excerpt, include)
        )
        .drop("include", "exclude", "min_score")
    )


def resolve(names: list[str], declared: list[str], override: list[str] | None = None) -> list[str]:
    """Declared entries selected by a list where ``*`` means all, narrowed by an override."""
    wanted = names
    if override:
        wanted = override if "*" in names else [n for n in names if n in override]
    return list(declared) if "*" in wanted else [d for d in declared if d in wanted]


def resolve_lists(names: Column, override: Column) -> Column:
    """The override intersection for lists held in columns."""
    return (
        F.when(F.coalesce(F.size(override), F.lit(0)) <= 0, names)
        .when(F.array_contains(names, "*"), override)
        .otherwise(F.filter(names, lambda n: F.array_contains(override, n)))
    )


def needed_sources(sections: list[dict]) -> list[str]:
    """Sources read by the enabled sections; used to prune the landing table."""
    return sorted({name for s in sections if s.get("enabled", True) for name in s["sources"]})


def prune_sources(landing: DataFrame, sections: list[dict]) -> DataFrame:
    """Only rows of sources somebody reads; a partition filter on a landing table."""
    return landing.where(F.col("source").isin(needed_sources(sections)))


def resolved_sources(spark: SparkSession, sections: DataFrame, sources: DataFrame) -> DataFrame:
    """The same pruning for section and source tables."""
    read = sections.where("enabled").select(F.explode("sources").alias("name"))
    return sources.join(read, "name", "left_semi")


def source_table(spark: SparkSession, sources: list[dict]) -> DataFrame:
    return dimension(spark, sources, SOURCE)
