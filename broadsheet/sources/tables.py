"""Adapters from the given Parquet tables to the library's records.

Reads name their columns and types, so no file is opened to infer a schema, only those
columns are scanned, and time predicates reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP, o_orderpriority STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def lead_sentence(text: Column) -> Column:
    """What stands before the first sentence end or line break: a document's headline."""
    return F.trim(F.regexp_extract(text, r"^[^.!?\n]*", 0))


def event_items(spark: SparkSession, folder: str) -> DataFrame:
    """Scored items: one source per event type, the value as score."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat_ws(" ", "event_type", F.lit("by"), "user_id").alias("title"),
        F.concat(F.lit("https://events.example.com/"), "event_id").alias("url"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("published_at"),
        F.col("value").alias("score"),
        F.col("props").alias("excerpt"),
        F.col("event_id").alias("item_pos"),
    )


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """Unscored items: the lead sentence as title, equal texts share an id."""
    return table(spark, folder, "documents").select(
        F.substring(F.sha2("text", 256), 1, 16).alias("id"),
        lead_sentence(F.col("text")).alias("title"),
        F.col("source"),
        F.col("text").alias("excerpt"),
        F.col("lang"),
        F.col("doc_id").alias("item_pos"),
    )


def benchmark_items(spark: SparkSession, folder: str) -> DataFrame:
    """An already published history."""
    return table(spark, folder, "benchmark").select(
        F.substring(F.sha2("text", 256), 1, 16).alias("id"),
        lead_sentence(F.col("text")).alias("title"),
    )
