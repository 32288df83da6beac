"""Which items get a summary, in which order, and within which budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.text import title_language, token_estimate, trim_space, utf16_length
from broadsheet.operators.topk import top_k
from broadsheet.schema import POLICY
from broadsheet.session import dimension

# Policy defaults when neither source, section nor configuration speaks.
DEFAULTS = {
    "summarize": False,
    "style": "bullet",
    "language": "zh-CN",
    "max_chars": 180,
    "fetch_full_text": False,
}


@dataclass(frozen=True)
class Gate:
    """When an item's own excerpt is not good enough; zeros and empty lists are "off"."""

    top_per_section: int = 0
    title_language_not: str | None = None
    excerpt_shorter_than: int = 0
    excerpt_matches: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Budget:
    max_items: int = 12
    max_chars_per_item: int = 6000
    max_total_chars: int = 80_000


def with_policy(items: DataFrame, policy: list[dict], defaults: dict | None = None) -> DataFrame:
    """Per field: the source's word, else the section's, else the default.

    A null means the layer says nothing; an explicit false is an answer.
    """
    spark = items.sparkSession
    names = list(DEFAULTS)
    base = {**DEFAULTS, **(defaults or {})}

    def layer(scope: str, key: str) -> DataFrame:
        rows = dimension(spark, [r for r in policy if r["scope"] == scope], POLICY)
        return rows.select(F.col("key").alias(key), *[F.col(n).alias(f"_{scope}_{n}") for n in names])

    joined = items.join(layer("source", "source"), "source", "left").join(
        layer("section", "section"), "section", "left"
    )
    for name in names:
        joined = joined.withColumn(
            name, F.coalesce(f"_source_{name}", f"_section_{name}", F.lit(base[name]))
        )
    return joined.drop(*[f"_{s}_{n}" for s in ("source", "section") for n in names])


def passes_gate(gate: Gate) -> Column:
    """Needs ``rank_in_section, title, excerpt, fetch_full_text``."""
    ok = F.lit(True)
    if gate.top_per_section > 0:
        ok = ok & (F.col("rank_in_section") < gate.top_per_section)
    if gate.title_language_not:
        ok = ok & (title_language(F.col("title")) != gate.title_language_not)
    if gate.excerpt_shorter_than <= 0 and not gate.excerpt_matches:
        return ok
    excerpt = F.coalesce("excerpt", F.lit(""))
    poor = trim_space(excerpt) == ""
    if gate.excerpt_shorter_than > 0:
        poor = poor | (F.length(excerpt) < gate.excerpt_shorter_than)
    for pattern in gate.excerpt_matches:
        poor = poor | excerpt.rlike(f"(?i){pattern}")
    return ok & (F.col("fetch_full_text") | poor)


def gated(items: DataFrame, gate: Gate) -> DataFrame:
    """Add ``candidate``: policy and gate both want a summary."""
    return items.withColumn("candidate", F.col("summarize") & passes_gate(gate))


def turn_order() -> Column:
    """Everyone's first item, then everyone's second: rank before section."""
    return F.struct("rank_in_section", "section_pos")


def with_turn(candidates: DataFrame) -> DataFrame:
    """Add the 0-based ``turn``; a run's line-up is bounded by its sections' limits."""
    order = Window.partitionBy("run_id").orderBy("rank_in_section", "section_pos")
    return candidates.withColumn("turn", F.row_number().over(order) - 1)


def _spend(max_items: int, max_total: int):
    """Walk one run's few possible tasks in turn order, charging what still fits."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank_in_section", "section_pos"], kind="stable")
        spent, taken, picked = 0, 0, []
        for cost in rows["reserved_chars"]:
            fits = taken < max_items and spent + cost <= max_total
            picked.append(fits)
            if fits:
                spent, taken = spent + cost, taken + 1
        return rows.assign(taken=picked)[["run_id", "rank_in_section", "section_pos", "taken"]]

    return walk


def allocate_budget(candidates: DataFrame, budget: Budget) -> DataFrame:
    """Add ``input, reserved_chars, decision`` to each candidate.

    Turn by turn: with the item budget used up a candidate is ``capped_by_items``; one
    whose reservation no longer fits is ``capped_by_chars`` and the walk goes on, so a
    later and smaller one may fit.

    The walk is sequential, but the rows it can choose from are bounded: of candidates
    with equal reservations only the first ``max_items`` can be taken, because once one is
    refused for space the later ones are too. Only those are walked, at most ``max_items``
    per distinct reservation and run. Every other row's decision follows from the turn at
    which the item budget ran out.
    """
    text = F.substring(F.coalesce("excerpt", F.lit("")), 1, budget.max_chars_per_item)
    costed = candidates.withColumn("input", text).withColumn(
        "reserved_chars",
        F.when(
            F.col("fetch_full_text"),
            F.greatest(utf16_length(F.col("input")), F.lit(budget.max_chars_per_item)),
        ).otherwise(utf16_length(F.col("input"))),
    )
    keys = ["run_id", "rank_in_section", "section_pos"]
    possible = top_k(
        costed.select(*keys, "reserved_chars"),
        ["run_id", "reserved_chars"],
        [F.asc("rank_in_section"), F.asc("section_pos")],
        max(budget.max_items, 1),
    ).drop("rank")
    taken = possible.groupBy("run_id").applyInPandas(
        _spend(budget.max_items, budget.max_total_chars),
        "run_id string, rank_in_section int, section_pos int, taken boolean",
    ).where("taken")
    last = taken.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_tasks"), F.max(F.struct(*keys[1:])).alias("_last")
    )
    full = (F.coalesce("_tasks", F.lit(0)) >= budget.max_items) & (
        F.col("_last").isNull() | (F.struct(*keys[1:]) > F.col("_last"))
    )
    decision = (
        F.when(F.col("taken"), "task")
        .when(full, "capped_by_items")
        .otherwise("capped_by_chars")
    )
    return (
        costed.join(taken, keys, "left")
        .join(last, "run_id", "left")
        .withColumn("decision", decision)
        .drop("taken", "_tasks", "_last")
    )


def estimated_tokens() -> Column:
    """Title plus input; for full text the reservation, by the script of the title."""
    reserved = F.ceil(
        F.col("reserved_chars")
        / F.when(title_language(F.col("title")) == "zh", F.lit(1)).otherwise(F.lit(4))
    )
    return token_estimate(F.col("title")) + F.when(F.col("fetch_full_text"), reserved).otherwise(
        token_estimate(F.col("input"))
    )


def plan_tasks(
    lineup: DataFrame,
    policy: list[dict],
    gate: Gate,
    budget: Budget,
    defaults: dict | None = None,
) -> DataFrame:
    """Every line-up row with its ``decision``: task, gated or the cap that refused it."""
    marked = gated(with_policy(lineup, policy, defaults), gate)
    planned = allocate_budget(marked.where("candidate"), budget)
    refused = (
        marked.where(~F.col("candidate"))
        .withColumn("input", F.lit(None).cast("string"))
        .withColumn("reserved_chars", F.lit(None).cast("int"))
        .withColumn("decision", F.lit("gated"))
    )
    return planned.unionByName(refused).drop("candidate")


def plan_measures() -> dict[str, Column]:
    """Counters of a plan, for run metrics."""
    is_task = F.col("decision") == "task"
    return {
        "planned": F.count_if(is_task),
        "gated": F.count_if(F.col("decision") == "gated"),
        "capped_by_items": F.count_if(F.col("decision") == "capped_by_items"),
        "capped_by_chars": F.count_if(F.col("decision") == "capped_by_chars"),
        "input_chars": F.coalesce(F.sum(F.when(is_task, F.col("reserved_chars"))), F.lit(0)),
    }
