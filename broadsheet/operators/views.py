"""Weekly review and reading views derived from archived issues alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.operators.topk import top_k
from broadsheet.sources.archive import INDEX_KEEP, issue_items, read_window, window_dates


def weekly_items(archive: DataFrame, end: str, days: int, sections: list[str]) -> DataFrame:
    """Distinct items of the window's issues; the newest issue's copy of an id wins.

    Only items of wanted sections compete. The winner is an aggregate, so an id repeated in
    any number of issues is reduced before it is shuffled.
    """
    rows = issue_items(read_window(archive, end, days)).where(F.col("section").isin(sections))
    newest = F.struct(
        (-F.unix_date(F.to_date("date"))).alias("d"),
        F.concat(F.concat_ws(".", "date", "slot"), F.lit(".json")).alias("file"),
        F.col("pos").alias("p"),
    )
    columns = [F.col(c) for c in rows.columns]
    first = F.min_by(F.struct(*columns), newest).alias("first")
    return rows.groupBy(F.col("id").alias("_id")).agg(first).select("first.*")


def weekly_review(
    archive: DataFrame, end: str, days: int, sections: list[str], limit: int
) -> DataFrame:
    """The best stored scores of the window per section; nothing is scored again."""
    order = [F.desc("rank_score"), F.desc("published_at"), F.asc("id")]
    return top_k(
        weekly_items(archive, end, days, sections), ["section"], order, limit
    )


def weekly_window(archive: DataFrame, end: str, days: int, sections: list[str]) -> DataFrame:
    """One row: dates covered, issues read, items collected before the cap."""
    first, last = window_dates(end, days)
    issues = read_window(archive, end, days).agg(F.count(F.lit(1)).alias("n"))
    items = weekly_items(archive, end, days, sections)
    return items.agg(F.count(F.lit(1)).alias("collected")).select(
        first.alias("from_date"),
        last.alias("to_date"),
        issues.select("n").scalar().alias("issues"),
        "collected",
    )


def month_outline(issues: DataFrame) -> DataFrame:
    """Issues per month, newest month first; a month has at most its days' slots."""
    entry = F.struct(
        (-F.unix_date(F.to_date("date"))).alias("d"),
        F.coalesce("slot", F.lit("")).alias("s"),
        F.concat_ws(".", "date", "slot").alias("issue"),
    )
    return (
        issues.groupBy(F.substring("date", 1, 7).alias("month"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
        .select("month", F.transform("rows", lambda r: r["issue"]).alias("issues"))
        .orderBy(F.desc("month"))
    )


def neighbours(issues: DataFrame) -> DataFrame:
    """The older and newer issue of each, in listing order.

    Found inside each month, then across months through one first and last issue per
    month, so no task orders the whole archive.
    """
    rows = issues.select("date", "slot").withColumn(
        "key",
        F.struct(
            (-F.unix_date(F.to_date("date"))).alias("d"),
            F.coalesce("slot", F.lit("")).alias("s"),
            F.concat_ws(".", "date", "slot").alias("issue"),
        ),
    ).withColumn("month", F.substring("date", 1, 7))
    within = Window.partitionBy("month").orderBy("key")
    months = rows.groupBy("month").agg(F.min("key").alias("newest"), F.max("key").alias("oldest"))
    across = Window.partitionBy(F.lit(0)).orderBy(F.desc("month"))
    edges = months.select(
        "month",
        F.lead("newest").over(across).alias("next_month"),
        F.lag("oldest").over(across).alias("previous_month"),
    )
    return (
        rows.withColumn("older", F.lead("key").over(within))
        .withColumn("newer", F.lag("key").over(within))
        .join(edges, "month")
        .select(
            "date",
            "slot",
            F.coalesce("older", "next_month")["issue"].alias("older"),
            F.coalesce("newer", "previous_month")["issue"].alias("newer"),
        )
    )


def by_section(issues: DataFrame, sections: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Items by declared section order; retired sections follow under their own id.

    With ``keep_unknown`` false (re-sending an issue) retired sections are dropped.
    """
    declared = sections.select(F.col("id").alias("section"), "section_pos", F.col("title").alias("t"))
    how = "left" if keep_unknown else "inner"
    return (
        issue_items(issues)
        .join(declared, "section", how)
        .withColumn("section_title", F.coalesce("t", "section"))
        .drop("t")
    )


def section_order() -> list:
    return [F.asc_nulls_last("section_pos"), F.asc("section"), F.asc("pos")]


def recent_index(issues: DataFrame, keep: int = INDEX_KEEP) -> DataFrame:
    """The newest ``keep`` issues with the archive's size and their items in order."""
    total = issues.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    shown = issues.orderBy(F.desc("date"), F.coalesce("slot", F.lit(""))).limit(keep)
    return shown.select(
        "date",
        "slot",
        F.concat(
            F.date_format(F.to_date("date"), "yyyy/MM/"), F.concat_ws(".", "date", "slot")
        ).alias("link"),
        F.col("generated_at").alias("published"),
        "item_count",
        F.transform("items", lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"), i["source"].alias("source"))).alias("entries"),
        total.alias("total_issues"),
    )


def preview(issues: DataFrame, titles: int = 3) -> DataFrame:
    """The first titles of each issue on one line."""
    first = F.slice(F.transform("items", lambda i: i["title"]), 1, titles)
    return issues.withColumn("preview", F.array_join(first, "　·　"))


def issue_text() -> Column:
    """What a search of issues looks at: date, slot, titles and sources in lower case."""
    words = F.concat_ws(
        " ",
        F.array("date", F.coalesce("slot", F.lit(""))),
        F.transform("items", lambda i: F.concat(i["title"], F.lit(" "), i["source"])),
    )
    return F.lower(words)


def item_text(item: Column | None = None) -> Column:
    """What a search of items looks at: title and source in lower case, of the row or of ``item``."""
    title, source = (F.col(c) if item is None else item[c] for c in ("title", "source"))
    return F.lower(F.concat(title, F.lit(" "), source))


def search_issues(issues: DataFrame, phrase: str) -> DataFrame:
    """Issues whose date, slot, titles or sources contain the phrase, ignoring case."""
    return issues.where(F.contains(issue_text(), F.lit(phrase.strip().lower())))


def search_items(issues: DataFrame, phrase: str) -> DataFrame:
    """The matching items themselves."""
    return issue_items(issues).where(F.contains(item_text(), F.lit(phrase.strip().lower())))
