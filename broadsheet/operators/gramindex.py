"""Near duplicates of the history by an index that grows with each issue.

The index holds the grams of every archived title, dealt to folders by gram, and is extended by
the new versions of the archive only. New titles look up their rarest grams, as many as any match
must share one of: since the index holds all grams of its titles, no order of grams has to be
common to both sides. Only folders of these grams are read. What shares enough is counted on all
its grams.

The results are those of ``dedupe.near_published`` over the same window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.dedupe import TITLE_SIMILARITY, _title_groups, with_title_facts
from broadsheet.operators.neardup import TOP_GRAMS, postings, title_nodes
from broadsheet.session import materialize
from broadsheet.sources import sidetables
from broadsheet.sources.archive import HISTORY_DAYS, read_window
from broadsheet.sources.versions import manifest

NAME = "title_grams"
SCHEMA = "gram STRING, numbers STRING, node BIGINT, n INT"


def _grams(issues: DataFrame) -> DataFrame:
    """(gram, numbers, node, n) of the titles of issues; a node is a title key with numbers."""
    rows = issues.select("version", "date", "slot", F.explode("items.title").alias("title"))
    facts = with_title_facts(rows).drop("title").distinct()
    nodes = title_nodes(facts.withColumn("node", F.struct("version", "date", "slot", F.xxhash64("title_key", "numbers").alias("id"))))
    return nodes.select(
        F.explode("grams").alias("gram"),
        "numbers",
        F.col("node.id").alias("node"),
        "n",
        "node.date",
        "node.slot",
        "node.version",
    ).withColumn("bucket", sidetables.bucket(F.col("gram")))


def extend(spark: SparkSession, path: str) -> list[str]:
    """Add the titles of versions that the index lacks; returns these versions."""
    return sidetables.extend(spark, path, NAME, _grams)


def near_published(items: DataFrame, path: str, today: str, days: int = HISTORY_DAYS, threshold: float = TITLE_SIMILARITY) -> DataFrame:
    """(title_key, numbers) of item titles that match a title published in the window.

    ``items`` has ``title_key, numbers, trust``. Titles with fewer grams than any match needs,
    empty ones included, match nothing.
    """
    spark = items.sparkSession
    extend(spark, path)
    live = read_window(manifest(spark, path), today, days)
    mine = _title_groups(items)
    nodes = materialize(title_nodes(mine), "titles")
    wanted = nodes.select(F.explode("grams").alias("gram")).distinct().select("gram", sidetables.bucket(F.col("gram")).alias("bucket"))
    # No more than there are folders.
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    known = sidetables.read(spark, path, NAME, SCHEMA, buckets, live).select("gram", "numbers", "node", "n", "bucket").distinct()
    # The grams that are most frequent in the history are looked up last.
    counts = known.join(wanted, ["bucket", "gram"], "left_semi").groupBy("gram").count()
    top = counts.orderBy(F.desc("count"), "gram").limit(TOP_GRAMS)
    frequent = top.agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("top")).select(
        F.transform("top", lambda e: e["gram"]).alias("frequent")
    )
    offered = postings(nodes, frequent, threshold).withColumn("bucket", sidetables.bucket(F.col("gram")))
    theirs = known.withColumnsRenamed({"node": "b_node", "n": "b_n"})
    ratio = threshold / (2 - threshold) - 1e-9
    met = offered.join(theirs, ["bucket", "gram", "numbers"])
    met = met.where((F.col("n") >= F.col("b_n") * ratio) & (F.col("b_n") >= F.col("n") * ratio))
    counted = met.groupBy("node", "b_node", "n", "b_n", "rest").agg(F.count(F.lit(1)).alias("shared"))
    enough = 2 * (F.col("shared") + F.col("rest")) / (F.col("n") + F.col("b_n")) >= threshold - 1e-9
    hopeful = materialize(counted.where(enough).select("node", "b_node", "n", "b_n"), "hopeful")
    whole = nodes.select("node", F.explode("grams").alias("gram")).withColumn("bucket", sidetables.bucket(F.col("gram")))
    both = hopeful.join(whole, "node").join(theirs.select("bucket", "gram", "b_node").distinct(), ["bucket", "gram", "b_node"])
    shared = both.groupBy("node", "b_node", "n", "b_n").agg(F.count(F.lit(1)).alias("shared"))
    near = shared.where(2 * F.col("shared") / (F.col("n") + F.col("b_n")) >= threshold)
    return mine.join(near.select("node").distinct(), "node", "left_semi").select("title_key", "numbers")
