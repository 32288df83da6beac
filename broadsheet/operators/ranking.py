"""Scores, total order, quota line-ups and exclusive sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.times import age_seconds
from broadsheet.operators.filters import section_candidates, source_facts
from broadsheet.operators.topk import top_k
from broadsheet.session import let, materialize

# score = weight x (0.6 x percentile + 0.4 x recency); 0.5 without a score.
SCORE_SHARE = 0.6
RECENCY_SHARE = 0.4
UNSCORED = 0.5

#: Least number of score ranges of a percentile, and rows of a range before there are more.
CUTS = 128
RANGE_ROWS = 1_000_000


def mid_rank(df: DataFrame, keys: list[str], score: str = "score", cuts: int | None = None) -> DataFrame:
    """Add ``percentile``: (strictly lower + half of ties) / scored rows, per group.

    Ranking needs the order within a group, and one group may hold most of the rows. The
    rows are therefore ranked inside score ranges: approximate quantiles of all scores cut
    the axis into about equal ranges, their number growing with the rows, and every cut
    value is a range of its own. A small table of counts per group and range supplies what
    lies below. Only rows strictly between two cuts are ordered; rows on a cut, as all rows
    of a very frequent score are, take their place from the counts, and unscored rows need
    nothing at all.
    """
    if cuts is None:
        cuts = max(CUTS, -(-df.count() // RANGE_ROWS))
    steps = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    accuracy = F.lit(max(10_000, 10 * cuts))
    points = df.agg(F.array_distinct(F.percentile_approx(score, steps, accuracy)).alias("p"))
    halves = F.array(*[F.lit(2**i) for i in reversed(range(cuts.bit_length()))])

    def place(at: Column) -> Column:
        """Twice the number of cuts below the score, plus 1 on a cut."""
        value = F.col(score)
        # Binary search for the number of cuts strictly below.
        below_score = F.aggregate(
            halves,
            F.lit(0),
            lambda found, step: F.when(
                F.try_element_at(at, found + step) < value, found + step
            ).otherwise(found),
        )
        return let(
            below_score,
            lambda n: 2 * n + F.when(F.try_element_at(at, n + 1) == value, 1).otherwise(0),
        )

    scored = (
        df.where(F.col(score).isNotNull())
        .withColumn("_points", points.select("p").scalar())
        .withColumn("_range", let(F.col("_points"), place))
        .drop("_points")
    )
    counts = scored.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_range")
    bases = counts.withColumn("_base", F.sum("_n").over(below) - F.col("_n")).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*keys))
    )
    joined = scored.join(bases, [*keys, "_range"])
    part = [*keys, "_range"]
    on_cut = F.pmod("_range", F.lit(2)) == 1
    inside = Window.partitionBy(*part).orderBy(score)
    ordered = joined.where(~on_cut).withColumn(
        "percentile",
        (F.col("_base") + F.rank().over(inside) - 1 + F.count(F.lit(1)).over(Window.partitionBy(*part, score)) / 2)
        / F.col("_total"),
    )
    level = joined.where(on_cut).withColumn("percentile", (F.col("_base") + F.col("_n") / 2) / F.col("_total"))
    unscored = df.where(F.col(score).isNull()).withColumn("percentile", F.lit(UNSCORED))
    out = [*df.columns, "percentile"]
    return ordered.select(*out).unionByName(level.select(*out)).unionByName(unscored.select(*out))


def recency(at: Column, now: Column, lookback_hours: Column) -> Column:
    """1 now, 0 at the end of the window and beyond; 0 for an empty window."""
    hours = age_seconds(now, at) / 3600
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - hours / F.nullif(lookback_hours, F.lit(0.0))))
    return F.when(lookback_hours <= 0, F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def round6(value: Column) -> Column:
    """Six places by the binary-double rule: floor(x * 1e6 + 0.5) / 1e6."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def rank_scores(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rank_score``. Needs ``weight, now, lookback_hours``; ``keys`` name the section."""
    scored = mid_rank(candidates, [*keys, "source"])
    value = F.col("weight") * (
        SCORE_SHARE * F.col("percentile")
        + RECENCY_SHARE
        * recency(F.col("published_at"), F.col("now"), F.col("lookback_hours").cast("double"))
    )
    return scored.withColumn("rank_score", round6(value))


def total_order() -> list[Column]:
    return [F.desc("rank_score"), F.desc("published_at"), F.asc("id")]


def quota_lineup(ranked: DataFrame, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Pick each section's line-up: reserved seats per source first, then by rank.

    Needs ``limit`` and ``min_per_source``. The largest limit in use is read from ``rows``,
    a written table of the same rows if there is one, so no row's own limit is cut. A source can never place an item below its own ``limit``-th, so each source is first cut
    to that many; what remains per section is bounded by the configuration.

    Seats are dealt in rounds: the r-th item of every source, sources in the order of
    their best item. That is one sort key per row, so no loop is needed.
    """
    order = total_order()
    most = (ranked if rows is None else rows).agg(F.max("limit")).first()[0] or 0
    per_source = top_k(ranked, [*keys, "source"], order, most, rank="_nth")
    per_source = per_source.where(F.col("_nth") <= F.col("limit"))
    section = Window.partitionBy(*keys)
    source = Window.partitionBy(*keys, "source").orderBy("_nth")
    placed = per_source.withColumn(
        "_overall", F.row_number().over(section.orderBy(*order))
    ).withColumn("_best", F.min("_overall").over(source))
    reserved = F.col("_nth") <= F.col("min_per_source")
    deal = F.when(reserved, F.struct(F.lit(0).alias("a"), F.col("_nth").alias("b"), F.col("_best").alias("c"))).otherwise(
        F.struct(F.lit(1).alias("a"), F.col("_overall").alias("b"), F.lit(0).alias("c"))
    )
    chosen = placed.withColumn("_seat", F.row_number().over(section.orderBy(deal))).where(
        F.col("_seat") <= F.col("limit")
    )
    return chosen.withColumn(
        "rank_in_section", F.row_number().over(section.orderBy(*order)) - 1
    ).drop("_nth", "_overall", "_best", "_seat")


def section_lineups(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Score and pick on narrow rows, then fetch the texts of the few that were chosen.

    The candidates are written once, since percentiles read them three times and they are
    far fewer than the items. Only what ranking needs is shuffled; the picks are written
    too, so that the join back sees their real, small size and leaves the texts in place.
    Ids are unique within ``keys``.
    """
    whole = materialize(candidates, "candidates")
    needed = ["id", "source", "score", "published_at", "now", "lookback_hours", "weight"]
    narrow = whole.select(*keys, *needed, "limit", "min_per_source")
    picks = quota_lineup(rank_scores(narrow, keys), keys, narrow).select(
        *keys, "id", "percentile", "rank_score", "rank_in_section"
    )
    return whole.join(materialize(picks, "picks"), [*keys, "id"])


def section_waves(sections: list[dict]) -> list[list[dict]]:
    """Group sections so that sections of one wave share no source.

    A section must wait for every earlier one it shares a source with; all others can be
    built in the same pass.
    """
    waves: list[list[dict]] = []
    depth: dict[str, int] = {}
    for section in sections:
        level = max((depth[s] + 1 for s in section["sources"] if s in depth), default=0)
        for source in section["sources"]:
            depth[source] = max(level, depth.get(source, 0))
        while len(waves) <= level:
            waves.append([])
        waves[level].append(section)
    return waves


def exclusive_lineups(
    items: DataFrame,
    sections: list[dict],
    sources: list[dict],
    run_keys: tuple[str, ...] = ("run_id",),
) -> DataFrame:
    """Line-ups in declared order; an item chosen once is gone for later sections.

    Chosen ids leave before the next section's percentiles are taken: each wave anti-joins
    the line-ups written so far, at most the sections' limits per run.
    """
    spark = items.sparkSession
    enabled = [s for s in sections if s.get("enabled", True)]
    facts = source_facts(spark, sources)
    keys = [*run_keys, "section"]
    done: list[DataFrame] = []
    for wave in section_waves(enabled):
        left = items
        for earlier in done:
            left = left.join(earlier.select(*run_keys, "id"), [*run_keys, "id"], "left_anti")
        done.append(section_lineups(section_candidates(left, wave, facts), keys))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
