"""Exact duplicates by combining in three steps, in built-in functions only.

Texts are equal if they are identical without white space. The row with the longest text
stays, of equally long ones the one with the smallest id.

1. Each task combines its own copies (the partial aggregation before the shuffle).
2. What is left of a digest meets in groups salted by the task that read it; only digests
   that make up a large share of all rows have several salts. There are at most ``HOT`` of
   them, so their table is small enough to send to every task.
3. The winners of the salts meet.

The full text is part of the key in every step, so texts that share a digest stay apart.
Rows then look up their group by digest alone; where a digest has several texts, a second
look-up compares the texts.

A null text counts as empty, and all empty texts are equal. A null id comes behind all others.
Every row gives one row; the other columns but the text are kept, columns named like a
result are replaced. Rows that repeat the staying row's id, text and length are one row twice:
all are marked ``kept``, and ``deduplicated`` leaves one of them. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import materialize
from broadsheet.sources.tables import table

SPACE = " \t\n\x0b\x0c\r"
#: A digest is hot if more than one row in ``HOT`` has it; its copies meet in ``SALTS`` groups.
HOT = 4096
SALTS = 64
RESULTS = ["keep_id", "group_size", "kept", "digest"]
#: Length and id in one number, so that the better row has the greater one.
WIDE = "decimal(38,0)"
SHIFT, TOP = Decimal(10**20), Decimal((1 << 63) - 1)


def normalised(text: Column) -> Column:
    """The text without white space; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _place(text: Column, key: Column) -> Column:
    """Greater for longer texts, then for smaller ids; 0 below the shift stands for no id."""
    low = F.coalesce(F.lit(TOP) - key.cast("decimal(20,0)") + 1, F.lit(Decimal(0)))
    return (F.coalesce(F.length(text), F.lit(0)).cast("decimal(10,0)") * F.lit(SHIFT) + low).cast(WIDE)


def _id(place: Column) -> Column:
    low = (place % F.lit(SHIFT)).cast("decimal(20,0)")
    return F.when(low > 0, (F.lit(TOP) + 1 - low).cast("long"))


def _groups(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, place of the row that stays, rows, texts), for digests of several rows."""
    rows = docs.select(digest(F.col("_norm")).alias("digest"))
    common = rows.groupBy("digest").agg(F.count("*").alias("rows")).filter("rows > 1")
    common = materialize(common, "digests")
    least = max(2, docs.count() // HOT)
    hot = F.broadcast(common.filter(F.col("rows") > least).select("digest", F.lit(True).alias("_hot")))
    read = docs.select(digest(F.col("_norm")).alias("digest"), "_norm", "_place", F.spark_partition_id().alias("_task"))
    salted = read.join(hot, "digest", "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_task") % SALTS))
    merged = salted.groupBy("_salt", "digest", "_norm").agg(F.max("_place").alias("_place"), F.count("*").alias("_rows"))
    # A text with one salt is whole by now; only texts with several have to meet again.
    winners = merged.select("digest", F.when(F.col("_salt").isNotNull(), F.col("_norm")).alias("_norm"), "_place", "_rows")
    met = winners.repartition("digest").groupBy("digest", "_norm").agg(
        F.max("_place").alias("_place"),
        F.sum("_rows").alias("_rows"),
        F.when(F.col("_norm").isNull(), F.count("*")).otherwise(F.lit(1)).alias("_texts"),
    )
    found = met.groupBy("digest").agg(F.max("_place").alias("_place"), F.sum("_rows").alias("_rows"), F.sum("_texts").alias("_texts"))
    return materialize(found.filter("_rows > 1").withColumn("_hot", F.col("_rows") > least), "groups")


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group by digest; hot ones need no shuffle."""
    columns = ["digest", "_place", "_rows", "_texts"]
    hot = groups.filter("_hot").select(*(F.col(c).alias(f"_hot{c}") for c in columns))
    rest = groups.filter("NOT _hot").select(*(F.col(c).alias(f"_rest{c}") for c in columns))
    out = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hotdigest"), "left")
    # Rows that have found their group spread evenly over the second join.
    key = F.when(F.col("_hotdigest").isNull(), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string"))
    out = out.withColumn("_key", key).join(rest, F.col("_key") == F.col("_restdigest"), "left")
    picked = [F.coalesce(f"_hot{c}", f"_rest{c}").alias(f"_group{c}") for c in columns[1:]]
    return out.select(*rows.columns, *picked)


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and digest; without its text unless asked.

    ``digest`` is any function of a text to a string. Weak ones only cost time: texts are
    compared in full.
    """
    kept = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in RESULTS and (c != text or keep_text)}
    own = [normalised(F.col(text)).alias("_norm"), _place(F.col(text), F.col(key)).alias("_place")]
    plain = docs.select(*own)
    groups = _groups(plain, digest)
    rows = docs.select(*(F.col(c).alias(n) for c, n in kept.items()), *own)
    rows = rows.withColumn("digest", digest(F.col("_norm")))
    shared = groups.filter("_texts > 1").select("digest")
    if shared.isEmpty():
        out = _joined(rows.drop("_norm"), groups)
    else:
        split = plain.withColumn("digest", digest(F.col("_norm"))).join(shared, "digest", "left_semi")
        texts = split.groupBy("digest", "_norm").agg(F.max("_place").alias("_text_place"), F.count("*").alias("_text_rows"))
        out = _joined(rows, groups).join(texts, ["digest", "_norm"], "left")
        out = out.withColumn("_group_place", F.coalesce("_text_place", "_group_place"))
        out = out.withColumn("_group_rows", F.coalesce("_text_rows", "_group_rows"))
    place = F.coalesce("_group_place", "_place")
    return out.select(
        *(F.col(n).alias(c) for c, n in kept.items()),
        _id(place).alias("keep_id"),
        F.coalesce("_group_rows", F.lit(1)).cast("long").alias("group_size"),
        (place == F.col("_place")).alias("kept"),
        "digest",
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    stays = marked(rows, names[text], names[key], keep_text=True).filter("kept")
    # Only rows that repeat an id can be kept twice.
    once = stays.dropDuplicates([names[key], "digest"])
    return once.select(*(F.col(n).alias(c) for c, n in names.items()))


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = marked(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
