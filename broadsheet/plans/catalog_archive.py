"""Registered queries on the archive and the views derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import views
from broadsheet.operators.topk import top_k
from broadsheet.plans.catalog_selection import SECTIONS, SECTIONS_SQL
from broadsheet.plans.daily import run_daily
from broadsheet.plans.issue import Run, config_stamp
from broadsheet.schema import SECTION
from broadsheet.session import dimension, work_path
from broadsheet.sources import archive, tables
from broadsheet.streaming import jobs

PER_SECTION = 20
TODAY = "2024-01-29"

#: Section of each source in the archived line-ups; ``retired`` is no longer declared.
_SECTION_OF = {"click": "traffic", "view": "traffic", "error": "retired", "purchase": "market"}


def archived_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line-ups for an archive: the best events per day, slot and section."""
    hour = F.hour("published_at")
    slot = F.when(hour < 10, F.lit(None)).when(hour < 20, "evening").otherwise("weekly")
    section = F.coalesce(
        F.create_map(*[F.lit(x) for p in _SECTION_OF.items() for x in p])[F.col("source")],
        F.lit("market"),
    )
    order = {s["id"]: s["section_pos"] for s in SECTIONS}
    rows = (
        tables.event_items(spark, sf)
        .withColumn("date", F.date_format("published_at", "yyyy-MM-dd"))
        .withColumn("slot", slot.cast("string"))
        .withColumn("section", section)
        .withColumn("section_pos", F.when(section == "market", order["market"]).when(section == "traffic", order["traffic"]).otherwise(9))
        .withColumn("rank_score", F.col("score"))
        # The same user's items share an id within a section, so reviews have repeats.
        .withColumn("id", F.concat_ws("-", "source", F.pmod("item_pos", F.lit(700)).cast("string")))
        .withColumn("run_id", F.concat_ws(".", "date", "slot"))
    )
    best = top_k(
        rows,
        ["run_id", "section"],
        [F.desc("rank_score"), F.asc("item_pos")],
        PER_SECTION,
    )
    return best.withColumn("rank_in_section", F.col("rank") - 1)


def issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = archived_rows(spark, sf)
    runs = rows.groupBy("run_id").agg(F.first("date").alias("date"), F.first("slot").alias("slot")).select(
        "run_id",
        "date",
        "slot",
        F.coalesce("slot", F.lit("daily")).alias("schedule_id"),
        F.to_timestamp("date").alias("generated_at"),
        config_stamp(F.lit("sections: events")).alias("config_hash"),
        F.lit("UTC").alias("timezone"),
        F.lit(24.0).alias("lookback_hours"),
    )
    return archive.build_issues(rows, runs)


ARCHIVE_SQL = f"""
src AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date,
    CASE WHEN hour(ts) < 10 THEN NULL WHEN hour(ts) < 20 THEN 'evening' ELSE 'weekly' END AS slot,
    CASE WHEN event_type IN ('click', 'view') THEN 'traffic' WHEN event_type = 'error' THEN 'retired' ELSE 'market' END AS section,
    event_type || '-' || (event_id % 700) AS id, event_type || ' by ' || user_id AS title, 'https://events.example.com/' || event_id AS url FROM events),
top AS (SELECT *, row_number() OVER (PARTITION BY date, slot, section ORDER BY value DESC, event_id) AS rn FROM src),
rows AS (SELECT *, CASE section WHEN 'market' THEN 0 WHEN 'traffic' THEN 1 ELSE 9 END AS section_order FROM top WHERE rn <= {PER_SECTION}),
arch AS (SELECT *, row_number() OVER (PARTITION BY date, slot ORDER BY section_order, rn) - 1 AS pos FROM rows),
issues AS (SELECT date, slot, count(*) AS item_count, list(title ORDER BY pos) AS titles, list(title || ' ' || event_type ORDER BY pos) AS words,
   list(url ORDER BY pos) AS urls FROM arch GROUP BY 1, 2)"""
WEEK_SQL = f"""{ARCHIVE_SQL},
win AS (SELECT * FROM arch WHERE date BETWEEN '2024-01-16' AND '{TODAY}' AND slot IS DISTINCT FROM 'weekly')"""


def window_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The archive written by partitions; only those of the window's months are scanned."""
    path = work_path(spark, "archive")
    archive.write_archive(issues(spark, sf), path)
    recent = archive.read_window(archive.read_archive(spark, path), TODAY)
    return archive.issue_items(recent).select(
        "date", "slot", F.col("pos").cast("bigint").alias("pos"), "id", "title"
    )


WINDOW_SCAN_SQL = f"WITH {WEEK_SQL} SELECT date, slot, pos, id, title FROM win"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The archive as JSON documents with paths; every seventh day's is broken."""
    out = issues(spark, sf)
    name = F.concat(
        F.date_format(F.to_date("date"), "yyyy/MM/"), F.concat_ws(".", "date", "slot"), F.lit(".json")
    )
    broken = F.dayofmonth(F.to_date("date")) % 7 == 0
    body = F.to_json(F.struct(*out.columns))
    return out.select(
        name.alias("path"), F.when(broken, F.substring(body, 1, 40)).otherwise(body).alias("body")
    )


def full_listing(spark: SparkSession, sf: str) -> DataFrame:
    parsed = archive.parse_documents(_documents(spark, sf))
    return archive.list_issues(parsed).withColumn("item_count", F.col("item_count").cast("bigint"))


LISTING_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot, CASE WHEN day(CAST(date AS DATE)) % 7 = 0 THEN 0 ELSE item_count END AS item_count,
 strftime(CAST(date AS DATE), '%Y/%m/') || date || coalesce('.' || slot, '') || '.md' AS path FROM issues"""


def skipped_documents(spark: SparkSession, sf: str) -> DataFrame:
    return archive.site_issues(archive.parse_documents(_documents(spark, sf)))[1]


SKIPPED_SQL = f"""WITH {ARCHIVE_SQL} SELECT strftime(CAST(date AS DATE), '%Y/%m/') || date || coalesce('.' || slot, '') || '.json' AS path
FROM issues WHERE day(CAST(date AS DATE)) % 7 = 0"""


def archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Write twice (a re-run replaces), add an empty issue, read back."""
    path = work_path(spark, "archive")
    out = issues(spark, sf)
    archive.write_archive(out, path, ["purchase by 1"])
    rerun = out.where(F.col("date") >= TODAY)
    empty = rerun.withColumn("items", F.slice("items", 1, 0)).withColumn("date", F.lit("2024-03-01"))
    archive.write_archive(rerun.unionByName(empty), path, ["purchase by 1"])
    back = archive.issue_items(archive.read_archive(spark, path))
    return back.select(
        "date", "slot", F.col("pos").cast("bigint").alias("pos"), "id", "title", "rank_score"
    )


ROUND_TRIP_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot, pos, id,
  replace(title, 'purchase by 1', '[REDACTED]') AS title, value AS rank_score FROM arch"""


def recent_index(spark: SparkSession, sf: str) -> DataFrame:
    return views.recent_index(issues(spark, sf)).select(
        "date",
        "slot",
        "link",
        F.date_format("published", "yyyy-MM-dd").alias("published"),
        F.col("item_count").cast("bigint").alias("item_count"),
        F.array_join(F.transform("entries", lambda e: e["url"]), " ").alias("urls"),
        "total_issues",
    )


INDEX_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot, strftime(CAST(date AS DATE), '%Y/%m/') || date || coalesce('.' || slot, '') AS link,
 date AS published, item_count, array_to_string(urls, ' ') AS urls, (SELECT count(*) FROM issues) AS total_issues
FROM issues ORDER BY date DESC, coalesce(slot, '') LIMIT 30"""


def weekly_review(spark: SparkSession, sf: str) -> DataFrame:
    review = views.weekly_review(issues(spark, sf), TODAY, 7, ["market", "traffic"], 12)
    return review.select("section", F.col("rank").cast("bigint").alias("rank"), "id", "rank_score", "date")


_WEEKLY = f"""WITH {ARCHIVE_SQL},
w AS (SELECT * FROM arch WHERE date BETWEEN '2024-01-23' AND '{TODAY}' AND slot IS DISTINCT FROM 'weekly' AND section IN ('market', 'traffic')),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC, date || coalesce('.' || slot, '') || '.json', pos) AS copy FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY value DESC, ts DESC, id) AS rank FROM d WHERE copy = 1)"""
WEEKLY_SQL = f"{_WEEKLY} SELECT section, rank, id, value AS rank_score, date FROM r WHERE rank <= 12"


def weekly_window(spark: SparkSession, sf: str) -> DataFrame:
    return views.weekly_window(issues(spark, sf), TODAY, 7, ["market", "traffic"])


WEEKLY_WINDOW_SQL = f"""{_WEEKLY} SELECT '2024-01-23' AS from_date, '{TODAY}' AS to_date,
 (SELECT count(*) FROM issues WHERE date BETWEEN '2024-01-23' AND '{TODAY}' AND slot IS DISTINCT FROM 'weekly') AS issues,
 (SELECT count(*) FROM r) AS collected"""


def month_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Over the long span of the orders table: an issue per order date."""
    dated = tables.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("slot")
    ).distinct()
    return views.month_outline(dated).select("month", F.array_join("issues", " ").alias("issues"))


MONTH_SQL = """SELECT substr(d, 1, 7) AS month, string_agg(d, ' ' ORDER BY d DESC) AS issues
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) GROUP BY 1"""


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Older and newer issue over one issue per order date and priority."""
    dated = tables.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderstatus")).alias("slot"),
    ).distinct()
    return views.neighbours(dated)


NEIGHBOUR_SQL = """WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN 'f' END AS slot FROM orders)
SELECT date, slot, lead(date || coalesce('.' || slot, '')) OVER o AS older, lag(date || coalesce('.' || slot, '')) OVER o AS newer
FROM d WINDOW o AS (ORDER BY date DESC, coalesce(slot, ''))"""


def by_section(spark: SparkSession, sf: str) -> DataFrame:
    sections = dimension(spark, SECTIONS, SECTION)
    out = views.by_section(issues(spark, sf), sections)
    return out.select(
        "date", "slot", "section", "section_title",
        F.col("section_pos").cast("bigint").alias("section_pos"), F.col("pos").cast("bigint").alias("pos"), "id",
    )


BY_SECTION_SQL = f"""WITH {ARCHIVE_SQL}, {SECTIONS_SQL} SELECT date, slot, section, coalesce(sections.title, section) AS section_title,
  section_pos, pos, arch.id FROM arch LEFT JOIN sections ON sections.id = arch.section"""


def resend_sections(spark: SparkSession, sf: str) -> DataFrame:
    sections = dimension(spark, SECTIONS, SECTION)
    out = views.by_section(issues(spark, sf), sections, keep_unknown=False)
    return out.groupBy("date", "slot", "section").agg(F.count(F.lit(1)).alias("n"))


RESEND_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot, section, count(*) AS n FROM arch WHERE section <> 'retired' GROUP BY ALL"""


def previews(spark: SparkSession, sf: str) -> DataFrame:
    return views.preview(issues(spark, sf)).select("date", "slot", "preview")


PREVIEW_SQL = f"WITH {ARCHIVE_SQL} SELECT date, slot, array_to_string(titles[1:3], '　·　') AS preview FROM issues"


def search(spark: SparkSession, sf: str) -> DataFrame:
    return views.search_issues(issues(spark, sf), " BY 17 Click ").select("date", "slot")


SEARCH_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot FROM issues
WHERE contains(lower(date || ' ' || coalesce(slot, '') || ' ' || array_to_string(words, ' ')), 'by 17 click')"""


def search_items(spark: SparkSession, sf: str) -> DataFrame:
    return views.search_items(issues(spark, sf), "by 17").select("date", "slot", "id", "title")


SEARCH_ITEMS_SQL = f"""WITH {ARCHIVE_SQL} SELECT date, slot, id, title FROM arch WHERE contains(lower(title || ' ' || event_type), 'by 17')"""


def stamped(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration stamps of every configuration text (here: event properties)."""
    return tables.table(spark, sf, "events").groupBy(config_stamp(F.col("props")).alias("config_hash")).agg(
        F.count(F.lit(1)).alias("n")
    )


STAMP_SQL = "SELECT substr(sha256(props), 1, 12) AS config_hash, count(*) AS n FROM events GROUP BY 1"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = jobs.file_stream(spark, sf, tables.COLUMNS["events"], "events.parquet")
    return raw.select(
        F.concat_ws("-", "event_type", "user_id").alias("id"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("published_at"),
    )


def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a stream; ids once, read back from the files it wrote."""
    path = work_path(spark, "stream")
    query = jobs.append_to_table(
        jobs.distinct_items(_stream(spark, sf)).select("id", "source"), f"{path}/out", f"{path}/log"
    )
    query.awaitTermination()
    return spark.read.schema("id STRING, source STRING").parquet(f"{path}/out")


STREAM_SQL = "SELECT DISTINCT event_type || '-' || user_id AS id, event_type AS source FROM events"


def stream_freshness(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "stream")
    jobs.upserts_to_table(
        jobs.source_freshness(_stream(spark, sf)), f"{path}/out", f"{path}/log"
    ).awaitTermination()
    schema = "window_start TIMESTAMP, source STRING, n_items BIGINT, latest TIMESTAMP, epoch BIGINT"
    rows = jobs.latest_rows(spark.read.schema(schema).parquet(f"{path}/out"), ["window_start", "source"])
    shown = "yyyy-MM-dd HH:mm:ss"
    return rows.select(
        F.date_format("window_start", shown).alias("window_start"), "source", "n_items", F.date_format("latest", shown).alias("latest")
    )


FRESHNESS_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS source, count(*) AS n_items,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1, 2"""


def stream_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Each micro-batch becomes archived issues, one per day, whose slot names the epoch."""
    path = work_path(spark, "stream")

    def build(batch: DataFrame, epoch: int) -> DataFrame:
        rows = batch.withColumn("run_id", F.date_format("published_at", "yyyy-MM-dd")).withColumns(
            {
                "section": F.lit("market"),
                "section_pos": F.lit(0),
                "title": F.col("id"),
                "rank_score": F.unix_seconds("published_at").cast("double"),
            }
        )
        best = top_k(rows, ["run_id"], [F.desc("published_at"), F.asc("id")], 25)
        runs = best.select("run_id").distinct().select(
            "run_id",
            F.col("run_id").alias("date"),
            F.lit(f"batch-{epoch}").alias("slot"),
            F.lit("stream").alias("schedule_id"),
            F.to_timestamp("run_id").alias("generated_at"),
            F.lit("").alias("config_hash"),
            F.lit("UTC").alias("timezone"),
            F.lit(24.0).alias("lookback_hours"),
        )
        return archive.build_issues(best.withColumn("rank_in_section", F.col("rank") - 1), runs)

    jobs.issues_from_stream(_stream(spark, sf), build, f"{path}/archive", f"{path}/log").awaitTermination()
    rows = archive.issue_items(archive.read_archive(spark, f"{path}/archive"))
    return rows.select("date", "slot", F.col("pos").cast("bigint").alias("pos"), "id")


STREAM_ISSUES_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS date, 'batch-0' AS slot,
 row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_type || '-' || user_id) - 1 AS pos, event_type || '-' || user_id AS id
FROM events QUALIFY pos < 25"""

#: Sources of the end-to-end run, a third of each type; the last one is never declared.
DAILY_SOURCES = [
    {"name": f"src{i}", "source_pos": i, "type": ("rss", "hackernews", "github")[i % 3], "weight": 1.0 + i % 2, "stale_after_days": 30, "fetch_limit": 400}
    for i in range(19)
]
DAILY_SECTIONS = [
    {"id": kind, "section_pos": pos, "title": kind, "sources": [s["name"] for s in DAILY_SOURCES if s["type"] == kind], "limit": 12, "min_per_source": 1, "include": [], "exclude": [], "enabled": True}
    for pos, kind in enumerate(("rss", "hackernews", "github"))
]


def daily_landing(spark: SparkSession, sf: str, day: int) -> DataFrame:
    """All documents as bodies of fifty entries, fetched on one of two days. Each type of
    source has bodies of its own form; one source's bodies are cut off and one fails."""
    at = F.concat(F.lit("2024-01-"), F.lpad(F.lit(day).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    kind = F.pmod(F.substr("source", F.lit(4)).cast("int"), F.lit(3))
    title, link = tables.lead_sentence(F.col("text")), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    clean = F.regexp_replace(title, r"[<>&\x00-\x1F]", " ")
    entry = F.struct(
        "doc_id",
        F.concat(F.lit("<item><title>"), clean, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), at, F.lit("</pubDate></item>")).alias("xml"),
        F.struct(F.col("doc_id").cast("string").alias("objectID"), title.alias("title"), link.alias("url"), F.pmod("doc_id", F.lit(97)).alias("points"), at.alias("created_at")).alias("story"),
        F.struct(title.alias("full_name"), link.alias("html_url"), F.pmod("doc_id", F.lit(89)).alias("stargazers_count"), at.alias("created_at")).alias("repo"),
    )
    rows = tables.table(spark, sf, "documents").withColumns({"kind": kind, "body_pos": F.floor(F.col("doc_id") / 1000)})
    bodies = rows.groupBy("source", "kind", "body_pos").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    body = (
        F.when(F.col("kind") == 0, F.concat(F.lit("<rss><channel>"), F.array_join("e.xml", ""), F.lit("</channel></rss>")))
        .when(F.col("kind") == 1, F.to_json(F.struct(F.col("e.story").alias("hits"))))
        .otherwise(F.to_json(F.struct(F.col("e.repo").alias("items"))))
    )
    return bodies.select(
        F.lit(f"day-{day}").alias("run_id"),
        "source",
        "body_pos",
        F.to_timestamp(at).alias("fetched_at"),
        F.when(F.col("source") == "src4", 503).otherwise(200).alias("status"),
        F.when(F.col("source") == "src7", F.substring(body, 1, 40)).otherwise(body).alias("body"),
    )


def daily_issue(spark: SparkSession, sf: str) -> DataFrame:
    """Two days from landed bodies to the archive, the second against the first; the archived
    items read back, the warnings and the metrics, each as rows."""
    path = work_path(spark, "daily")
    metrics = None
    for day in (30, 31):
        run = Run(f"day-{day}", f"2024-01-{day} 11:00:00", "UTC")
        old = archive.read_archive(spark, path) if metrics is not None else None
        titled = lambda tasks: tasks.select("run_id", F.col("id").alias("item_id"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.to_json(F.struct(F.col("title").alias("summary"))).alias("raw"))
        done = run_daily(spark, daily_landing(spark, sf, day), run, DAILY_SECTIONS, DAILY_SOURCES, old, titled, 0.5, [{"scope": "section", "key": "rss", "summarize": True}], path=path)
        metrics = done.metrics if metrics is None else metrics.unionByName(done.metrics)
    written = archive.read_archive(spark, path)
    none = F.lit(None).cast("string")
    items = archive.issue_items(written).select("date", F.lit("item").alias("kind"), F.col("section").alias("name"), F.col("id").alias("value"), F.col("summary").isNotNull().cast("double").alias("number"))
    warned = written.select("date", F.lit("warning").alias("kind"), none.alias("name"), F.explode("warnings").alias("value"), F.lit(None).cast("double").alias("number"))
    counted = metrics.select(F.concat(F.lit("2024-01-"), F.right("run_id", F.lit(2))).alias("date"), F.concat(F.lit("metric "), "stage").alias("kind"), F.col("metric").alias("name"), none.alias("value"), F.col("value").alias("number"))
    return items.unionByName(warned).unionByName(counted)


QUERIES = {
    "daily_issue": (daily_issue, None),
    "archive_window": (window_scan, WINDOW_SCAN_SQL),
    "archive_listing": (full_listing, LISTING_SQL),
    "archive_skipped": (skipped_documents, SKIPPED_SQL),
    "archive_round_trip": (archive_round_trip, ROUND_TRIP_SQL),
    "recent_index": (recent_index, INDEX_SQL),
    "weekly_review": (weekly_review, WEEKLY_SQL),
    "weekly_window": (weekly_window, WEEKLY_WINDOW_SQL),
    "month_outline": (month_outline, MONTH_SQL),
    "neighbours": (neighbours, NEIGHBOUR_SQL),
    "by_section": (by_section, BY_SECTION_SQL),
    "resend_sections": (resend_sections, RESEND_SQL),
    "issue_preview": (previews, PREVIEW_SQL),
    "search_issues": (search, SEARCH_SQL),
    "search_items": (search_items, SEARCH_ITEMS_SQL),
    "config_stamp": (stamped, STAMP_SQL),
    "stream_distinct_items": (stream_distinct, STREAM_SQL),
    "stream_source_freshness": (stream_freshness, FRESHNESS_SQL),
    "stream_issues": (stream_issues, STREAM_ISSUES_SQL),
}
