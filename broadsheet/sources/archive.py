"""The issue archive: sink, window scan and full listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.redact import redact_rows
from broadsheet.schema import ISSUE

# The slot of the weekly review and the archive's defaults.
WEEKLY_SLOT = "weekly"
HISTORY_DAYS = 14
INDEX_KEEP = 30

_FILE_NAME = r"(?i)(?:^|/)(\d{4})/(\d{2})/(\d{4}-\d{2}-\d{2})(?:\.([a-z0-9-]+))?\.json$"
_PARTITIONS = T.StructType(
    [T.StructField("year", T.StringType()), T.StructField("month", T.StringType())]
)


def is_reprint(slot: Column) -> Column:
    """Weekly reviews repeat items filed under their own days."""
    return F.coalesce(slot == WEEKLY_SLOT, F.lit(False))


def build_issues(items: DataFrame, runs: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One record per run from line-up rows.

    ``items`` is a line-up, so a run holds no more rows than its sections' limits add up
    to. ``runs`` carries the issue's own fields by ``run_id``; runs without items go.
    """
    fields = [f.name for f in ISSUE["items"].dataType.elementType.fields]
    have = set(items.columns)
    types = {f.name: f.dataType for f in ISSUE["items"].dataType.elementType.fields}
    record = F.struct(
        *[
            (F.col(n) if n in have else F.lit(None)).cast(types[n]).alias(n)
            for n in fields
        ]
    )
    grouped = items.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("section_pos", "rank_in_section", record.alias("item")))
        ).alias("rows")
    )
    issues = runs.join(grouped, "run_id").withColumn(
        "items", F.transform("rows", lambda r: r["item"])
    )
    if warnings is not None:
        texts = warnings.groupBy("run_id").agg(
            F.array_sort(F.collect_list("warning")).alias("warnings")
        )
        issues = issues.join(texts, "run_id", "left").withColumn(
            "warnings", F.coalesce("warnings", F.array().cast("array<string>"))
        )
    else:
        issues = issues.withColumn("warnings", F.array().cast("array<string>"))
    if "digest" not in issues.columns:
        issues = issues.withColumn("digest", F.lit(None).cast(ISSUE["digest"].dataType))
    return issues.withColumn("item_count", F.size("items")).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ISSUE.fields]
    )


def slot_for(enabled_schedules: int, schedule_id: str) -> str | None:
    """A slot only disambiguates when more than one schedule is live."""
    return schedule_id if enabled_schedules > 1 else None


def write_archive(
    issues: DataFrame, path: str, secrets: list[str] | None = None, form: str = "parquet"
) -> None:
    """Write issues by year, month, date and slot; a re-run replaces its own partition.

    Every string is redacted first; an issue without items is not written. Rows of one
    partition are brought together so that a partition is one file.
    """
    kept = issues.where(F.size("items") > 0)
    dated = (
        redact_rows(kept, secrets)
        .withColumn("year", F.substring("date", 1, 4))
        .withColumn("month", F.substring("date", 6, 2))
    )
    (
        dated.repartition("year", "month", "date", "slot")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "date", "slot")
        .format(form)
        .save(path)
    )


def read_archive(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    schema = T.StructType(ISSUE.fields + _PARTITIONS.fields)
    return spark.read.format(form).schema(schema).load(path)


def window_dates(today: str, days: int) -> tuple[Column, Column]:
    """First and last date of the ``days`` ending today."""
    last = F.to_date(F.lit(today))
    return F.date_format(F.date_sub(last, days - 1), "yyyy-MM-dd"), F.lit(today)


def read_window(archive: DataFrame, today: str, days: int = HISTORY_DAYS) -> DataFrame:
    """Issues of the last ``days`` days without weekly reviews; prunes partitions."""
    first, last = window_dates(today, days)
    out = archive.where(F.col("date").between(first, last) & ~is_reprint(F.col("slot")))
    if {"year", "month"} <= set(archive.columns):
        out = out.where(
            F.concat("year", F.lit("-"), "month").between(
                F.substring(first, 1, 7), F.substring(last, 1, 7)
            )
        )
    return out


def issue_items(issues: DataFrame) -> DataFrame:
    """One row per archived item with its issue's date and slot and its position."""
    return issues.select("date", "slot", F.posexplode("items").alias("pos", "item")).select(
        "date", "slot", "pos", "item.*"
    )


def parse_documents(documents: DataFrame) -> DataFrame:
    """(path, body) JSON documents to records; ``valid`` is false for unreadable ones.

    A file outside ``year/month/date[.slot].json`` is not an archive file.
    """

    def part(group: int) -> Column:
        return F.regexp_extract("path", _FILE_NAME, group)

    schema = T.StructType(ISSUE.fields + [T.StructField("_corrupt_record", T.StringType())])
    record = F.from_json(
        "body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    return (
        documents.where(F.col("path").rlike(_FILE_NAME))
        .select(
            "path",
            part(3).alias("file_date"),
            F.nullif(part(4), F.lit("")).alias("file_slot"),
            record.alias("record"),
        )
        .withColumn(
            "valid",
            F.coalesce(
                F.col("record._corrupt_record").isNull() & F.col("record.items").isNotNull(),
                F.lit(False),
            ),
        )
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files below a folder, one row each."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    )


def list_issues(parsed: DataFrame) -> DataFrame:
    """Index listing: newest date first, then slot; unreadable files count no items."""
    count = F.when(
        F.col("valid"), F.coalesce("record.item_count", F.size("record.items"))
    ).otherwise(F.lit(0))
    return parsed.select(
        F.col("file_date").alias("date"),
        F.col("file_slot").alias("slot"),
        F.regexp_replace(F.regexp_extract("path", r"(\d{4}/\d{2}/[^/]+)$", 1), r"\.json$", ".md").alias("path"),
        count.alias("item_count"),
    ).orderBy(F.desc("date"), F.coalesce("slot", F.lit("")))


def site_issues(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable records, skipped paths)."""
    readable = parsed.where("valid").select("record.*", F.col("path")).drop("_corrupt_record")
    return readable, parsed.where("not valid").select("path")
