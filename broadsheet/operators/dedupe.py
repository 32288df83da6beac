"""Duplicates within a run and against what was already published.

An item survives when no earlier survivor, in trust order, has its id, its title key or a
matching title: the lexicographically first maximal independent set of the conflict graph.
Dropped items block nobody, so neither distinct rows nor connected components will do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.text import title_key, title_numbers
from broadsheet.operators.graphs import components
from broadsheet.operators.neardup import matching_pairs, pair_work, title_nodes
from broadsheet.session import dimension, materialize

#: Default Dice threshold; 0 turns the title comparison off.
TITLE_SIMILARITY = 0.2

#: Gram meetings that the matching pairs of one batch may cause before its key range is halved.
WORK_BUDGET = 2e10

#: Rows and edges of a component that one group walks.
COMPONENT = 200_000
#: Rows and edges of the small components that share a group, about: a group costs more than its rows.
BIN = 1 << 14

_RANKS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("source_rank", T.IntegerType())]
)


def with_trust_key(items: DataFrame, sources: list[dict]) -> DataFrame:
    """Add ``trust``: a number of its own for each row, in the order in which rows are believed:
    by weight, declared source, source name, body, payload position and id.

    Sources are ranked in the configuration; a source nobody declared weighs 1 and comes
    after the declared ones of that weight. ``body_pos`` orders the bodies of a source and
    counts as 0 where there is none. The rows are sorted by ranges and numbered in the order
    of their ranges, so no task sees more than its range, and rows that agree in everything
    still differ in their number. The numbered rows are written once.
    """
    spark = items.sparkSession
    order = sorted(
        [(-(s.get("weight", 1.0)), i, s["name"]) for i, s in enumerate(sources)]
        + [(-1.0, len(sources), None)]
    )
    ranks = [{"source": name, "source_rank": r} for r, (_, _, name) in enumerate(order) if name]
    unknown = next(r for r, (_, _, name) in enumerate(order) if name is None)
    body = F.col("body_pos") if "body_pos" in items.columns else F.lit(0)
    keys = ["source_rank", "source", "_body", "item_pos", "id"]
    ranked = (
        items.join(dimension(spark, ranks, _RANKS), "source", "left")
        .withColumns({"source_rank": F.coalesce("source_rank", F.lit(unknown)), "_body": body})
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("trust", F.monotonically_increasing_id())
    )
    return materialize(ranked.drop("_body"), "trusted")


def _title_or_own(title_key: Column, id_: Column) -> Column:
    """The title key; an untitled row has a key of its own, which no title equals."""
    return F.when(title_key == "", F.concat(F.lit("\x00"), id_)).otherwise(title_key)


def with_title_facts(items: DataFrame) -> DataFrame:
    return items.withColumn("title_key", title_key(F.col("title"))).withColumn(
        "numbers", title_numbers(F.col("title"))
    )


def history_facts(history: DataFrame) -> DataFrame:
    """The archived (id, title) pairs as a comparison table; worth keeping as a table."""
    return with_title_facts(history.select("id", "title"))


def published_exactly(items: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``seen``: the id or the non-empty title key is in the history.

    The history is reduced to distinct keys first, so the join cannot multiply rows.
    """
    ids = history.select("id").distinct().withColumn("_id_seen", F.lit(True))
    titles = (
        history.select(F.col("title_key").alias("_own"))
        .where(F.col("_own") != "")
        .distinct()
        .withColumn("_title_seen", F.lit(True))
    )
    return (
        items.withColumn("_own", _title_or_own(F.col("title_key"), F.col("id")))
        .join(ids, "id", "left")
        .join(titles, "_own", "left")
        .withColumn("seen", F.col("_id_seen").isNotNull() | F.col("_title_seen").isNotNull())
        .drop("_id_seen", "_title_seen", "_own")
    )


def unseen(items: DataFrame, history: DataFrame) -> DataFrame:
    """Items whose id and title are both new."""
    titles = history.select("title_key").where(F.col("title_key") != "")
    return items.join(history.select("id"), "id", "left_anti").join(
        titles, "title_key", "left_anti"
    )


def _title_groups(rows: DataFrame) -> DataFrame:
    """One node per distinct title key and numbers, named by its smallest trust key."""
    return rows.groupBy("title_key", "numbers").agg(F.min("trust").alias("node"))


def near_published(items: DataFrame, history: DataFrame, threshold: float) -> DataFrame:
    """(title_key, numbers) of item titles that match a published title."""
    mine = _title_groups(items)
    theirs = (
        history.select("title_key", "numbers")
        .distinct()
        .withColumn("node", F.xxhash64("title_key", "numbers"))
    )
    pairs = matching_pairs(
        materialize(title_nodes(mine), "titles"),
        materialize(title_nodes(theirs), "published"),
        threshold,
    )
    return mine.join(
        pairs.select(F.col("a_node").alias("node")).distinct(), "node", "left_semi"
    ).select("title_key", "numbers")


def near_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(a_node, b_node, score) of matching, different titles; a node is a trust key."""
    nodes = materialize(title_nodes(_title_groups(items)), "titles")
    return matching_pairs(nodes, None, threshold)


def _collapse_copies(items: DataFrame) -> DataFrame:
    """Keep one row of each set of items that conflict with exactly the same others.

    Copies with one id, title key and numbers do. So do items whose ids nobody else has
    when title key and numbers agree. Both steps are plain aggregations with map-side
    partials, so a group of copies of any size ends as one row.
    """
    reps = items.groupBy("id", "title_key", "numbers").agg(F.min("trust").alias("trust"))
    by_id = reps.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("trust").alias("trust"),
        F.first("title_key").alias("title_key"),
        F.first("numbers").alias("numbers"),
    )
    own = F.when(F.col("title_key") == "", F.col("id")).otherwise(F.lit(""))
    single = (
        by_id.where(F.col("n") == 1)
        .groupBy("title_key", "numbers", own.alias("_own"))
        .agg(F.min(F.struct("trust", "id")).alias("first"))
        .select("first.id", "title_key", "numbers", "first.trust")
    )
    shared = reps.join(by_id.where(F.col("n") > 1).select("id"), "id", "left_semi")
    return single.unionByName(shared.select("id", "title_key", "numbers", "trust"))


def _first_keys(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.min("trust").alias("trust"))


def _independent(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Survivors among ``rows`` (trust, id, title_key, node) with title edges by node.

    Each round keeps every item that is the first of its id group, title group and node
    and precedes all matching nodes, then removes what those items conflict with. Groups
    meet only through their minimum, and winners are found by joining on the unique trust
    key, so no round handles a group's pairs.
    """
    undecided = rows
    kept: DataFrame | None = None
    both_ways = None
    if edges is not None:
        both_ways = edges.select(
            F.col("a_node").alias("node"), F.col("b_node").alias("other")
        ).unionByName(edges.select(F.col("b_node").alias("node"), F.col("a_node").alias("other")))
    while True:
        by_node = _first_keys(undecided, "node")
        titled = undecided.where(F.col("title_key") != "")
        winners = undecided.join(_first_keys(undecided, "id").select("trust"), "trust", "left_semi")
        winners = winners.join(by_node.select("trust"), "trust", "left_semi")
        winners = winners.join(
            _first_keys(titled, "title_key")
            .select("trust")
            .unionByName(undecided.where(F.col("title_key") == "").select("trust")),
            "trust",
            "left_semi",
        )
        if both_ways is not None:
            nearest = (
                both_ways.join(
                    by_node.select(F.col("node").alias("other"), F.col("trust").alias("_t")),
                    "other",
                )
                .groupBy("node")
                .agg(F.min("_t").alias("_nearest"))
            )
            winners = (
                winners.join(nearest, "node", "left")
                .where(F.col("_nearest").isNull() | (F.col("trust") < F.col("_nearest")))
                .drop("_nearest")
            )
        winners = materialize(winners, "kept")
        kept = winners if kept is None else kept.unionByName(winners)
        nodes = winners.select("node")
        if both_ways is not None:
            nodes = nodes.unionByName(
                both_ways.join(nodes, "node", "left_semi").select(F.col("other").alias("node"))
            )
        rest = (
            undecided.join(winners.select("id"), "id", "left_anti")
            .join(
                winners.select("title_key").where(F.col("title_key") != ""),
                "title_key",
                "left_anti",
            )
            .join(nodes, "node", "left_anti")
        )
        undecided = materialize(rest, "undecided")
        if undecided.isEmpty():
            return kept


def _walk(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule over each component of a bin: an item stays if nothing of its component
    that stays has its id, its title or a matching title."""
    near: dict[int, set[int]] = {}
    for a, b in zip(edges["a_node"], edges["b_node"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ids, titles, nodes, kept, walked = set(), set(), set(), [], None
    rows = rows.sort_values(["_component", "trust"])
    for component, id_, title, node in zip(rows["_component"], rows["id"], rows["title_key"], rows["node"]):
        if component != walked:
            ids, titles, nodes, walked = set(), set(), set(), component
        stays = id_ not in ids and title not in titles and node not in nodes and nodes.isdisjoint(near.get(node, ()))
        kept.append(stays)
        if stays:
            ids.add(id_)
            nodes.add(node)
            if title:
                titles.add(title)
    return rows.loc[kept].drop(columns=["_component", "_bin"])


def _binned(rows: DataFrame, bins: int) -> DataFrame:
    return rows.withColumn("_bin", F.pmod(F.xxhash64("_component"), F.lit(bins)))


def _by_components(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Survivors among conflicting rows, component by component.

    Conflicts reach no further than a connected component, so one of at most ``COMPONENT`` rows
    and edges is walked in trust order in one group, however long its chains are; small ones share
    groups of about ``BIN`` rows and edges. Only what belongs to a larger one is left to the
    rounds, which need no component in one place.
    """
    if edges is None:
        edges = rows.sparkSession.createDataFrame([], "a_node bigint, b_node bigint")
    edges = edges.select("a_node", "b_node")
    links = edges.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
    groups = [("id", rows), ("node", rows), ("title_key", rows.where(F.col("title_key") != ""))]
    for column, members in groups:
        first = _first_keys(members, column).select(column, F.col("trust").alias("v"))
        links = links.unionByName(members.join(first, column).select(F.col("trust").alias("u"), "v"))
    # A node is named by its least trust key; rows without conflicts left still name themselves.
    links = links.unionByName(rows.select(F.col("trust").alias("u"), F.col("node").alias("v")))
    labels = materialize(components(links), "components")
    placed = rows.join(labels.withColumnsRenamed({"node": "trust", "label": "_component"}), "trust", "left")
    placed = materialize(placed.withColumn("_component", F.coalesce("_component", "trust")), "placed")
    tied = edges.join(labels.withColumnsRenamed({"node": "a_node", "label": "_component"}), "a_node")
    tied = materialize(tied, "tied")
    entries = placed.select("_component").unionByName(tied.select("_component"))
    sizes = entries.groupBy("_component").count()
    large = materialize(sizes.where(F.col("count") > COMPONENT).select("_component"), "large")
    bins = max(1, -(-entries.count() // BIN))
    small_rows = placed.join(large, "_component", "left_anti")
    small_edges = tied.join(large, "_component", "left_anti")
    walked = (
        _binned(small_rows, bins).groupBy("_bin")
        .cogroup(_binned(small_edges, bins).groupBy("_bin"))
        .applyInPandas(_walk, rows.schema)
    )
    kept = materialize(walked, "walked")
    big_rows = placed.join(large, "_component", "left_semi").drop("_component")
    if large.isEmpty():
        return kept
    return kept.unionByName(_independent(big_rows, tied.join(large, "_component", "left_semi").drop("_component")))


def _split_conflicted(rows: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows that conflict with no other row, and the rest."""

    def alone(column: str, of: DataFrame = rows) -> DataFrame:
        # The only member of a group names itself, so the answer joins on a unique key.
        counted = of.groupBy(column).agg(
            F.count(F.lit(1)).alias("n"), F.first("trust").alias("trust")
        )
        return counted.where(F.col("n") == 1).select("trust", F.lit(True).alias(f"lone_{column}"))

    untitled = F.col("title_key") == ""
    flags = (
        rows.join(alone("id"), "trust", "left")
        .join(alone("node"), "trust", "left")
        .join(alone("title_key", rows.where(~untitled)), "trust", "left")
    )
    free = (
        F.col("lone_id").isNotNull()
        & F.col("lone_node").isNotNull()
        & (untitled | F.col("lone_title_key").isNotNull())
    )
    if edges is not None:
        touched = (
            edges.select(F.col("a_node").alias("node"))
            .unionByName(edges.select(F.col("b_node").alias("node")))
            .distinct()
            .withColumn("touched", F.lit(True))
        )
        flags = flags.join(touched, "node", "left")
        free = free & F.col("touched").isNull()
    split = materialize(flags.select(*rows.columns, free.alias("free")), "split")
    return split.where("free").drop("free"), split.where("not free").drop("free")


def survivors(
    items: DataFrame, threshold: float = TITLE_SIMILARITY, work_budget: float = WORK_BUDGET
) -> DataFrame:
    """The kept items' (trust, id, title_key, numbers, node) in trust order semantics.

    Trust ranges are processed in order. A range whose matching titles would exceed the
    budget is halved, so a family of near-copies meets only its first survivors instead of
    itself (the prefix rounds of Blelloch, Fineman and Shun 2012). Later ranges first lose
    whatever conflicts with earlier survivors. Titles that do not match are compared in any
    case, so for them a range is not halved.
    """
    collapsed = materialize(_collapse_copies(items), "collapsed")
    own = F.when(F.col("title_key") == "", F.col("id")).otherwise(F.lit(""))
    groups = (
        collapsed.groupBy("title_key", "numbers", own.alias("_own"))
        .agg(F.min("trust").alias("node"))
    )
    rows = materialize(
        collapsed.withColumn("_own", own)
        .join(groups, ["title_key", "numbers", "_own"])
        .select("trust", "id", "title_key", "numbers", "node"),
        "candidates",
    )
    low, high = rows.agg(F.min("trust"), F.max("trust")).first()
    if low is None:
        return rows
    todo = [(low, high)]
    kept: DataFrame | None = None
    while todo:
        low, high = todo.pop()
        batch = rows.where(F.col("trust").between(low, high))
        if kept is not None:
            batch = (
                batch.join(kept.select("id"), "id", "left_anti")
                .join(
                    kept.select("title_key").where(F.col("title_key") != ""),
                    "title_key",
                    "left_anti",
                )
            )
        edges = None
        if threshold > 0:
            nodes = title_nodes(batch.select("node", "title_key", "numbers").distinct())
            if kept is not None:
                old = materialize(
                    title_nodes(kept.select("node", "title_key", "numbers")), "published"
                )
                nodes = materialize(nodes, "titles")
                blocked = matching_pairs(nodes, old, threshold).select(
                    F.col("a_node").alias("node")
                )
                batch = materialize(batch.join(blocked, "node", "left_anti"), "batch")
                nodes = title_nodes(batch.select("node", "title_key", "numbers").distinct())
            nodes = materialize(nodes, "titles")
            # Titles cannot meet more often than all of the same numbers on all of their grams; only
            # a range for which that bound is too high is measured, and halved if need be.
            titles = F.col("titles").cast("double")
            groups = nodes.groupBy("numbers").agg(F.count(F.lit(1)).alias("titles"), F.max("n").alias("longest"))
            bound = groups.agg(F.sum(titles * (titles - 1) / 2 * F.col("longest"))).first()[0] or 0
            if bound > work_budget and low < high:
                if pair_work(nodes, threshold).first()[0] > work_budget:
                    middle = batch.agg(F.percentile_approx("trust", 0.5)).first()[0]
                    middle = min(middle, high - 1)
                    todo += [(middle + 1, high), (low, middle)]
                    continue
            edges = materialize(matching_pairs(nodes, None, threshold), "edges")
        free, conflicted = _split_conflicted(batch, edges)
        found = free if conflicted.isEmpty() else free.unionByName(_by_components(conflicted, edges))
        kept = found if kept is None else kept.unionByName(found)
    return kept


def label_drops(
    items: DataFrame, history: DataFrame | None = None, threshold: float = TITLE_SIMILARITY
) -> DataFrame:
    """Add ``cause``: null for kept items, else ``seen`` or ``within``.

    The first rule that applies decides: published exactly, exact repeat of an earlier
    kept item, title matches a published one, title matches an earlier kept item.
    ``items`` needs ``id, title, trust``.
    """
    facts = with_title_facts(items) if "title_key" not in items.columns else items
    seen = facts.withColumn("seen", F.lit(False)) if history is None else published_exactly(facts, history)
    # Written before titles are compared: what follows reads the rows several times.
    flagged = materialize(seen, "flagged")
    if history is not None and threshold > 0:
        near = near_published(flagged.where(~F.col("seen")), history, threshold)
        near = materialize(near.withColumn("near_seen", F.lit(True)), "near")
        flagged = flagged.join(near, ["title_key", "numbers"], "left").withColumn(
            "near_seen", F.coalesce("near_seen", F.lit(False))
        )
    else:
        flagged = flagged.withColumn("near_seen", F.lit(False))
    kept = survivors(flagged.where(~F.col("seen") & ~F.col("near_seen")), threshold)
    keys = kept.select("trust", F.lit(True).alias("_kept"))
    ids = kept.select("id", F.col("trust").alias("_id_trust"))
    titles = kept.where(F.col("title_key") != "").select(
        F.col("title_key").alias("_own"), F.col("trust").alias("_title_trust")
    )
    exact = F.coalesce(F.col("_id_trust") < F.col("trust"), F.lit(False)) | F.coalesce(
        F.col("_title_trust") < F.col("trust"), F.lit(False)
    )
    cause = (
        F.when(F.col("seen"), "seen")
        .when(F.col("_kept"), F.lit(None))
        .when(exact, "within")
        .when(F.col("near_seen"), "seen")
        .otherwise("within")
    )
    return (
        flagged.withColumn("_own", _title_or_own(F.col("title_key"), F.col("id")))
        .join(keys, "trust", "left")
        .join(ids, "id", "left")
        .join(titles, "_own", "left")
        .withColumn("cause", cause)
        .drop("_kept", "_id_trust", "_title_trust", "_own", "seen", "near_seen")
    )


def dedupe(
    items: DataFrame, history: DataFrame | None = None, threshold: float = TITLE_SIMILARITY
) -> DataFrame:
    """Only the items that survive."""
    return label_drops(items, history, threshold).where(F.col("cause").isNull()).drop("cause")


def drop_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("run_id").agg(
        F.count_if(F.col("cause") == "within").alias("dropped_within_run"),
        F.count_if(F.col("cause") == "seen").alias("dropped_as_seen"),
        F.count_if(F.col("cause").isNull()).alias("kept"),
    )
