"""Ranked selection and places per group that survive groups holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 32


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based ``rank``.

    A row among the first ``k`` of its group is among the first ``k`` of any part of it, so
    a group is cut in steps: inside each task before the first shuffle (the optimizer does
    this for a limited row number), inside ``SALTS`` bundles of tasks, then as a whole. The
    last step sees at most ``SALTS * k`` rows per group however large the group is.
    """
    parts = df.withColumn("_part", F.spark_partition_id() % SALTS)
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        parts.withColumn("_local", F.row_number().over(local))
        .where(F.col("_local") <= k)
        .drop("_part", "_local")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )


def places(rows: DataFrame, number: str, keys: list[str], name: str) -> DataFrame:
    """Add the 1-based place ``name`` of each row in its group (in the whole table without
    ``keys``).

    ``number`` is what ``monotonically_increasing_id`` gave after a sort by ranges, read from a
    written table. A row's place is its place in its range and what the group has in earlier
    ranges, so no task sees a whole group; the offsets are one row for each group and range.
    """
    at = F.shiftright(number, 33)
    parts = rows.groupBy(*keys, at.alias("_part")).agg(F.min(number).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_least") + 1
    parts = parts.select("_part", *(F.col(k).alias(f"_key_{k}") for k in keys), offset.alias("_offset"))
    same = F.col("_at") == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    placed = rows.withColumn("_at", at).join(parts, same)
    return placed.select(*rows.columns, (F.col(number) + F.col("_offset")).alias(name))
