"""Landed payloads to raw entries.

A landing table has one row per fetched body: ``run_id, source, fetched_at, status, body``.
Parsing is declarative (``from_xml`` and ``from_json`` with fixed schemas). A body that
fails becomes an error row for its source and never fails the run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import utf16_length

# The largest body, in UTF-16 units, that is parsed.
MAX_BODY = 8 * 1024 * 1024

# Discussion page of a story that has no page of its own.
DISCUSSION = "https://news.ycombinator.com/item?id="

_ENTRY = (
    "STRUCT<title: STRING, link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>,"
    " guid: STRING, id: STRING, pubDate: STRING, published: STRING, updated: STRING,"
    " `dc:date`: STRING, description: STRING, summary: STRING, content: STRING,"
    " `content:encoded`: STRING, `dc:creator`: STRING,"
    " author: STRUCT<_VALUE: STRING, name: STRING>>"
)

FEED_SCHEMA = (
    f"channel STRUCT<item: ARRAY<{_ENTRY}>>, item ARRAY<{_ENTRY}>, entry ARRAY<{_ENTRY}>,"
    " _corrupt_record STRING"
)
STORY_SCHEMA = (
    "hits ARRAY<STRUCT<objectID: STRING, title: STRING, story_title: STRING, url: STRING,"
    " story_url: STRING, points: INT, author: STRING, created_at: STRING,"
    " num_comments: INT>>, _corrupt_record STRING"
)
REPOSITORY_SCHEMA = (
    "items ARRAY<STRUCT<full_name: STRING, html_url: STRING, description: STRING,"
    " stargazers_count: INT, created_at: STRING, language: STRING,"
    " owner: STRUCT<login: STRING>>>, _corrupt_record STRING"
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def with_landing_error(landing: DataFrame, max_body: int = MAX_BODY) -> DataFrame:
    """Add ``error`` for bad statuses and bodies above the size cap; a bad status goes before an
    ``error`` that the landing table has already.

    A text has at most as many UTF-16 units as UTF-8 bytes, so only bodies with more bytes
    than the cap are measured.
    """
    size = F.when(F.octet_length("body") > max_body, utf16_length(F.col("body")))
    ok = F.col("status").between(200, 299)
    sized = landing.withColumn("_size", size)
    too_large = F.format_string("response too large: %d chars > %d", "_size", F.lit(max_body))
    known = F.col("error") if "error" in landing.columns else F.lit(None).cast("string")
    error = F.when(~ok, F.format_string("HTTP %d", "status")).when(known.isNotNull(), known)
    return sized.withColumn("error", error.when(F.col("_size") > max_body, too_large)).drop("_size")


def _feed_link(entry: Column) -> Column:
    """Link text, else an alternate link's target, else any target, else guid or id."""
    links = F.coalesce(entry["link"], F.array().cast("array<struct<_VALUE:string,_href:string,_rel:string>>"))

    def plain(link: Column) -> Column:
        return link["_href"].isNull() & link["_rel"].isNull()

    def preferred(link: Column) -> Column:
        alternate = link["_rel"].isNull() | (link["_rel"] == "alternate")
        return plain(link) | (link["_href"].isNotNull() & alternate)

    def target(found: Column) -> Column:
        first = F.try_element_at(found, F.lit(1))
        return F.when(
            F.size(found) > 0,
            F.when(plain(first), F.coalesce(first["_VALUE"], F.lit(""))).otherwise(first["_href"]),
        )

    only = F.try_element_at(links, F.lit(1))
    text = F.when(
        (F.size(links) == 1) & (plain(only) | only["_VALUE"].isNotNull()),
        F.coalesce(only["_VALUE"], F.lit("")),
    )
    return F.coalesce(
        text,
        target(F.filter(links, preferred)),
        target(F.filter(links, lambda link: link["_href"].isNotNull())),
        entry["guid"],
        entry["id"],
    )


def _feed_entry(entry: Column) -> list[Column]:
    author = entry["author"]
    return [
        entry["title"].alias("title"),
        _feed_link(entry).alias("url"),
        F.coalesce(
            entry["pubDate"], entry["published"], entry["updated"], entry["dc:date"]
        ).alias("published"),
        F.lit(None).cast("double").alias("score"),
        F.coalesce(entry["dc:creator"], author["_VALUE"], author["name"]).alias("author"),
        F.coalesce(
            entry["description"], entry["summary"], entry["content"], entry["content:encoded"]
        ).alias("excerpt"),
    ]


def _story_entry(hit: Column) -> list[Column]:
    page = F.concat(F.lit(DISCUSSION), hit["objectID"])
    points = F.coalesce(hit["points"], F.lit(0))
    comments = F.coalesce(hit["num_comments"], F.lit(0))
    return [
        F.coalesce(hit["title"], hit["story_title"], F.lit("")).alias("title"),
        F.coalesce(hit["url"], hit["story_url"], page).alias("url"),
        hit["created_at"].alias("published"),
        points.cast("double").alias("score"),
        hit["author"].alias("author"),
        F.format_string("%d points · %d comments · %s", points, comments, page).alias("excerpt"),
    ]


def _repository_entry(repo: Column) -> list[Column]:
    stars = F.coalesce(repo["stargazers_count"], F.lit(0))
    language = F.when(
        F.coalesce(repo["language"], F.lit("")) != "", F.concat(F.lit(" · "), repo["language"])
    ).otherwise(F.lit(""))
    about = F.coalesce(repo["description"], F.lit("(no description)"))
    return [
        repo["full_name"].alias("title"),
        repo["html_url"].alias("url"),
        repo["created_at"].alias("published"),
        stars.cast("double").alias("score"),
        repo["owner"]["login"].alias("author"),
        F.format_string("%s — ★%d%s", about, stars, language).alias("excerpt"),
    ]


def _parse(
    landing: DataFrame,
    parsed: Column,
    entries: Callable[[Column], Column],
    fields: Callable[[Column], list[Column]],
) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of a landing table."""
    checked = with_landing_error(landing).withColumn(
        "doc", F.when(F.col("error").isNull(), parsed)
    )
    broken = F.col("error").isNull() & (
        F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    )
    judged = checked.withColumn(
        "error", F.when(broken, F.lit("body could not be parsed")).otherwise(F.col("error"))
    )
    # Positions restart in every body; the body's own number keeps them apart.
    body = ["body_pos"] if "body_pos" in landing.columns else []
    rows = judged.where(F.col("error").isNull()).select(
        "run_id",
        "source",
        *body,
        F.col("fetched_at").alias("run_time"),
        F.posexplode(entries(F.col("doc"))).alias("item_pos", "entry"),
    )
    items = rows.select("run_id", "source", *body, "run_time", "item_pos", *fields(F.col("entry")))
    errors = judged.where(F.col("error").isNotNull()).select("run_id", "source", "error")
    return items, errors


def parse_feeds(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RSS 2.0, RDF and Atom bodies."""

    def entries(doc: Column) -> Column:
        none = F.array().cast(f"array<{_ENTRY}>")
        return F.concat(
            F.coalesce(doc["channel"]["item"], none),
            F.coalesce(doc["item"], none),
            F.coalesce(doc["entry"], none),
        )

    return _parse(landing, F.from_xml("body", FEED_SCHEMA, _OPTIONS), entries, _feed_entry)


def parse_stories(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Story-search JSON bodies."""
    parsed = F.from_json("body", STORY_SCHEMA, _OPTIONS)
    return _parse(landing, parsed, lambda doc: doc["hits"], _story_entry)


def parse_repositories(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repository-search JSON bodies."""
    parsed = F.from_json("body", REPOSITORY_SCHEMA, _OPTIONS)
    return _parse(landing, parsed, lambda doc: doc["items"], _repository_entry)


#: Source type to parser; a new kind of source is one more entry.
PARSERS = {"rss": parse_feeds, "hackernews": parse_stories, "github": parse_repositories}


def parse_landing(landing: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse every landed body with the parser of its source's type."""
    typed = landing.join(sources.select(F.col("name").alias("source"), "type"), "source")
    parts = [parse(typed.where(F.col("type") == kind)) for kind, parse in PARSERS.items()]
    items, errors = parts[0]
    for more_items, more_errors in parts[1:]:
        items, errors = items.unionByName(more_items), errors.unionByName(more_errors)
    return items, errors
