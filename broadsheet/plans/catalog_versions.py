"""Registered queries on the versioned archive, its indexes and the streams that feed it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import gramindex, searchindex
from broadsheet.plans.catalog_archive import ARCHIVE_SQL, TODAY, issues
from broadsheet.plans.catalog_planning import FEED_SQL, feed_bodies, shown
from broadsheet.plans.catalog_selection import PAIRS_SQL, SECTIONS, SOURCES, THRESHOLD, doc_facts
from broadsheet.plans.weekly import run_weekly
from broadsheet.session import materialize, work_path
from broadsheet.sources import archive, feeds, landing, tables, versions
from broadsheet.streaming import jobs
from broadsheet.streaming.issues import Paths, Plan, stream_issues
from broadsheet.streaming.silence import silent_stream


def _records(rows: DataFrame) -> DataFrame:
    """Issues from rows of date, slot, pos, id, title, url and source."""
    section = F.col("section") if "section" in rows.columns else F.lit("all")
    placed = rows.withColumns(
        {"run_id": F.concat_ws(".", "date", "slot"), "section": section, "section_pos": F.lit(0), "rank_in_section": F.col("pos")}
    )
    runs = placed.groupBy("run_id", "date", "slot").agg(F.count(F.lit(1)).alias("n")).select(
        "run_id", "date", "slot", F.lit("daily").alias("schedule_id"), F.to_timestamp("date").alias("generated_at"),
        F.lit("").alias("config_hash"), F.lit("UTC").alias("timezone"), F.lit(24.0).alias("lookback_hours"),
    )
    return archive.build_issues(placed, runs)


def archive_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Whole issues replace those of even days, which were cut short; the others stay cut."""
    path = work_path(spark, "versions")
    out = issues(spark, sf)
    versions.commit_issues(out.withColumn("items", F.slice("items", 1, 5)), path)
    versions.commit_issues(out.where(F.dayofmonth(F.to_date("date")) % 2 == 0), path)
    rows = archive.issue_items(versions.read_committed(spark, path))
    return rows.select("date", "slot", F.col("pos").cast("bigint").alias("pos"), "id", "title")


VERSIONS_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot, pos, id, title FROM arch
WHERE pos < 5 OR day(CAST(date AS DATE)) % 2 = 0"""


def _orders_archive(spark: SparkSession, sf: str) -> str:
    """All orders as items of monthly issues, one issue for each 500 customers: the number of
    issues grows with the data, their size does not. Two commits."""
    path = work_path(spark, "orders")
    rows = tables.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-01").alias("date"),
        F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 500)).alias("slot"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), "o_custkey").alias("title"),
        F.concat(F.lit("https://orders.example.com/"), "o_orderkey").alias("url"),
        F.col("o_orderpriority").alias("source"),
    )
    records = materialize(_records(rows), "orders")
    first = F.col("date") < "1998"
    versions.commit_issues(records.where(first), path)
    searchindex.extend(spark, path)
    versions.commit_issues(records.where(~first), path)
    return path


PHRASE = "of 17 1-Urgent"


def indexed_issues(spark: SparkSession, sf: str) -> DataFrame:
    return searchindex.search_issues(spark, _orders_archive(spark, sf), PHRASE).select("date", "slot", "item_count")


_ORDERS_SQL = """orders_ AS (SELECT strftime(o_orderdate, '%Y-%m-01') AS date, 'c' || (o_custkey // 500) AS slot, CAST(o_orderkey AS VARCHAR) AS id,
  'Order ' || o_orderkey || ' of ' || o_custkey AS title, o_orderpriority AS source FROM orders)"""
_MATCH = f"contains(lower(title || ' ' || source), '{PHRASE.lower()}')"
INDEXED_ISSUES_SQL = f"""WITH {_ORDERS_SQL} SELECT date, slot, CAST(count(*) AS INT) AS item_count FROM orders_ GROUP BY 1, 2 HAVING bool_or({_MATCH})"""


def indexed_items(spark: SparkSession, sf: str) -> DataFrame:
    return searchindex.search_items(spark, _orders_archive(spark, sf), PHRASE).select("date", "slot", "id", "title")


INDEXED_ITEMS_SQL = f"WITH {_ORDERS_SQL} SELECT date, slot, id, title FROM orders_ WHERE {_MATCH}"


def near_history_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose titles match an archived one at the documented similarity, by the index
    of an archive that was committed in two parts."""
    path = work_path(spark, "titles")
    rows = tables.table(spark, sf, "benchmark").select(
        F.format_string("2024-01-%02d", F.col("item_id") % 10 + 1).alias("date"),
        F.lit(None).cast("string").alias("slot"),
        F.col("item_id").alias("pos"),
        F.col("item_id").cast("string").alias("id"),
        tables.lead_sentence(F.col("text")).alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.lit("benchmark").alias("source"),
    )
    records = materialize(_records(rows), "benchmark")
    versions.commit_issues(records.where("date <= '2024-01-05'"), path)
    gramindex.extend(spark, path)
    versions.commit_issues(records.where("date > '2024-01-05'"), path)
    facts = materialize(doc_facts(spark, sf), "facts")
    near = gramindex.near_published(facts, path, "2024-01-12", threshold=0.2)
    return facts.join(near, ["title_key", "numbers"], "left_semi").select("doc_id", "title_key")


NEAR_INDEX_SQL = f"""WITH {PAIRS_SQL.replace(f'>= {THRESHOLD}', '>= 0.2')} SELECT f.item_pos AS doc_id, f.title_key FROM facts f
JOIN nodes n ON n.title_key = f.title_key AND n.numbers = f.numbers JOIN hnear h ON h.node = n.node"""


def _landed(spark: SparkSession, sf: str, path: str, parts: int) -> Iterator[DataFrame]:
    """The events landed in parts, in order of time: after each part the folder as a stream, to be
    read to its end before the next. A part has as many files as tasks wrote it."""
    events = tables.table(spark, sf, "events")
    part = F.least(F.lit(parts - 1), F.floor((F.dayofmonth("ts") - 1) * parts / 30))
    for i in range(parts):
        events.where(part == i).write.mode("append").parquet(path)
        yield spark.readStream.schema(tables.COLUMNS["events"]).parquet(path)


SILENT = timedelta(minutes=90)


def stream_silent_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of which nothing is dated for 90 minutes, over several files and batches."""
    path = work_path(spark, "silent")
    for raw in _landed(spark, sf, f"{path}/in", 4):
        items = raw.select(F.col("event_type").alias("source"), F.col("ts").alias("published_at"))
        jobs.append_to_table(silent_stream(items, SILENT), f"{path}/out", f"{path}/log").awaitTermination()
    rows = spark.read.schema("source STRING, latest TIMESTAMP, stale_at TIMESTAMP").parquet(f"{path}/out")
    return rows.select("source", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("latest", "stale_at")))


SILENT_SQL = """WITH e AS (SELECT event_type AS source, ts, max(ts) OVER () - INTERVAL 1 HOUR AS reach FROM events),
done AS (SELECT * FROM e WHERE time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= reach),
gaps AS (SELECT source, ts, coalesce(lead(ts) OVER (PARTITION BY source ORDER BY ts), reach) AS next FROM done)
SELECT source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS latest, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS stale_at
FROM gaps WHERE next > ts + INTERVAL 90 MINUTE"""


def stream_plan_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream in two parts; the whole plan builds an issue for each half of the month."""
    path = work_path(spark, "issues")
    half = lambda t: F.concat(F.date_format(t, "yyyy-MM-"), F.when(F.dayofmonth(t) <= 15, "15").otherwise("30"))
    plan = Plan(SECTIONS, SOURCES, lookback_hours=360, date=half)
    paths = Paths(f"{path}/out")
    for raw in _landed(spark, sf, f"{path}/in", 2):
        items = raw.select(
            F.col("event_id").cast("string").alias("id"),
            F.concat_ws(" ", "event_type", F.lit("by"), "user_id").alias("title"),
            F.concat(F.lit("https://events.example.com/"), "event_id").alias("url"),
            F.col("event_type").alias("source"),
            F.col("ts").alias("published_at"),
            F.col("value").alias("score"),
            F.col("props").alias("excerpt"),
            F.col("event_id").alias("item_pos"),
        )
        stream_issues(items, plan, paths).awaitTermination()
    rows = archive.issue_items(versions.read_committed(spark, paths.archive))
    return rows.select("date", F.col("pos").cast("bigint").alias("pos"), "section", "id", "rank_score")


def landed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The feeds as files of a landing folder, read and parsed as one batch."""
    path = work_path(spark, "landed")
    landing.land(feed_bodies(spark, sf), path)
    return shown(feeds.parse_feeds(landing.read_bodies(spark, path, "r")))


def stream_landed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The same folder as a stream: it fills in two parts, and the stream goes on after each."""
    path = work_path(spark, "landing")
    bodies = materialize(feed_bodies(spark, sf), "bodies")
    late = F.xxhash64("source") % 2 == 0
    for part in (~late, late):
        landing.land(bodies.where(part), f"{path}/in")
        rows = shown(feeds.parse_feeds(landing.stream_bodies(spark, f"{path}/in")))
        jobs.append_to_table(rows, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def _first_titles(entries: DataFrame) -> DataFrame:
    """An answer made of the first ten titles."""
    titles = F.array_sort(F.collect_list(F.when(F.col("entry") <= 10, F.struct("entry", "title"))))
    text = F.array_join(F.transform(titles, lambda e: e["title"]), ", ")
    return entries.groupBy("run_id").agg(F.to_json(F.struct(text.alias("digest"))).alias("raw")).select(
        "run_id", F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), "raw"
    )


def weekly_issue(spark: SparkSession, sf: str) -> DataFrame:
    """The review of a week of all events, committed twice beside the issues it is made of."""
    path = work_path(spark, "weekly")
    rows = tables.event_items(spark, sf)
    placed = rows.select(
        F.date_format("published_at", "yyyy-MM-dd").alias("date"),
        # Many issues a day, so that issues are small at any size of the data.
        F.concat(F.lit("c"), F.floor(F.col("item_pos") / 1000)).alias("slot"),
        F.col("item_pos").alias("pos"),
        F.concat_ws("-", "source", F.pmod("item_pos", F.lit(5000)).cast("string")).alias("id"),
        "title",
        "url",
        "source",
        "published_at",
        F.col("score").alias("rank_score"),
        F.when(F.col("source").isin("click", "view"), "traffic").when(F.col("source") == "error", "retired").otherwise("market").alias("section"),
    )
    versions.commit_issues(_records(placed), path)
    wanted = [{"id": "traffic", "section_pos": 0, "enabled": True}, {"id": "market", "section_pos": 1, "enabled": True}, {"id": "retired", "section_pos": 2, "enabled": False}]
    for _ in range(2):
        run_weekly(spark, path, TODAY, f"{TODAY} 08:00:00", wanted, digest=_first_titles, limit=12)
    found = versions.read_committed(spark, path).where(F.col("slot") == archive.WEEKLY_SLOT)
    items = found.select("date", "slot", "item_count", F.col("digest.text").alias("digest"), F.posexplode("items").alias("pos", "item"))
    return items.select("date", "slot", F.col("item_count").cast("bigint").alias("item_count"), "digest", F.col("pos").cast("bigint").alias("pos"), "item.section", "item.id", "item.title", "item.rank_score")


WEEKLY_ISSUE_SQL = f"""WITH src AS (SELECT event_type || '-' || (event_id % 5000) AS id, event_type || ' by ' || user_id AS title, value, ts, event_id,
  strftime(ts, '%Y-%m-%d') AS date, 'c' || (event_id // 1000) AS slot,
  CASE WHEN event_type IN ('click', 'view') THEN 'traffic' WHEN event_type = 'error' THEN 'retired' ELSE 'market' END AS section FROM events),
issue AS (SELECT *, row_number() OVER (PARTITION BY date, slot ORDER BY event_id) - 1 AS place FROM src WHERE date BETWEEN '2024-01-23' AND '{TODAY}' AND section <> 'retired'),
one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC, date || '.' || slot || '.json', place) AS copy FROM issue),
best AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY value DESC, ts DESC, id) AS rank FROM one WHERE copy = 1),
review AS (SELECT *, row_number() OVER (ORDER BY section DESC, rank) - 1 AS pos FROM best WHERE rank <= 12)
SELECT '{TODAY}' AS date, 'weekly' AS slot, count(*) OVER () AS item_count,
  (SELECT string_agg(title, ', ' ORDER BY pos) FROM review WHERE pos < 10) AS digest, pos, section, id, title, value AS rank_score FROM review"""


QUERIES = {
    "weekly_issue": (weekly_issue, WEEKLY_ISSUE_SQL),
    "landed_bodies": (landed_bodies, FEED_SQL),
    "stream_landed_bodies": (stream_landed_bodies, FEED_SQL),
    "archive_versions": (archive_versions, VERSIONS_SQL),
    "search_index_issues": (indexed_issues, INDEXED_ISSUES_SQL),
    "search_index_items": (indexed_items, INDEXED_ITEMS_SQL),
    "near_history_index": (near_history_index, NEAR_INDEX_SQL),
    "stream_silent_sources": (stream_silent_sources, SILENT_SQL),
    "stream_plan_issues": (stream_plan_issues, None),
}
