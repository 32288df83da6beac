"""Document fingerprints by a homomorphic multiset hash, in built-in functions only.

A fingerprint is a vector of counters modulo 2^32: the sum of one vector for each paragraph.
The sum ignores the order of paragraphs, and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text. The vector of a paragraph has

* ``WIDTH`` lanes hashed from the paragraph as a whole, which decide equality, and
* ``SIGNS`` lanes with one bit for each of its sentences. Of two fingerprints, the squared
  differences of these lanes, signed, estimate how many sentences the texts do not share;
  the likeness is one less that share of all their sentences (standard error about
  ``sqrt(2 / SIGNS)`` of the unshared share).

Paragraphs are lines, sentences end at stops and lines; empty ones do not count. Equal
paragraphs count as often as they occur. Null and empty texts have the zero vector; two
texts without sentences have likeness 1.

The next document by descending id is found without a global sort: ids fall into ranges of
about ``ROWS`` documents (their borders, 8 bytes a range, are all the driver sees), each
range also gets the first document of the range behind it, and one shuffle of the texts by
range serves both the order and the fingerprints. Null ids come last; repeated ids follow
each other by a hash of their texts.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.session import materialize
from broadsheet.sources.tables import table

WIDTH = 16
SIGNS = 64
ROWS = 8192
POWER = 1 << 32
LOW = POWER - 1
#: The lowest bit of both halves of a hash: two lanes are counted at once.
PAIR = (1 << 32) + 1


def lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint vector of a text column: sentences, WIDTH and SIGNS lanes."""
    df = df.withColumn("_paragraphs", F.transform(_filled(F.split(text, "\n")), lambda p: F.sha2(p, 256)))
    df = df.withColumn("_sentences", F.transform(_filled(F.split(text, r"[.!?\n]+\s*")), lambda s: F.xxhash64(s)))
    whole = [_sum("_paragraphs", partial(_whole, i)) for i in range(WIDTH)]
    pairs = [_sum("_sentences", partial(_pair, i)) for i in range(SIGNS // 2)]
    df = df.withColumn("_pairs", F.array(*pairs))
    halves = F.concat(
        F.transform("_pairs", lambda x: x.bitwiseAND(F.lit(LOW))),
        F.transform("_pairs", lambda x: F.shiftrightunsigned(x, 32)),
    )
    number = F.size("_sentences").cast("long")
    vector = F.concat(F.array(number, *(F.pmod(w, F.lit(POWER)) for w in whole)), halves)
    return df.withColumn(out, vector).drop("_paragraphs", "_sentences", "_pairs")


def _whole(lane: int, digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(lane)).bitwiseAND(F.lit(LOW))


def _pair(lane: int, value: Column) -> Column:
    return F.shiftrightunsigned(value, lane).bitwiseAND(F.lit(PAIR))


def _sum(values: str, part) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda n, v: n + part(v))


def _filled(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p != "")


def inserted(whole: Column, part: Column) -> Column:
    """The vector of a text with ``part``'s paragraphs added."""
    return F.zip_with(whole, part, lambda a, b: F.pmod(a + b, F.lit(POWER)))


def deleted(whole: Column, part: Column) -> Column:
    """The vector of a text with ``part``'s paragraphs taken away."""
    return F.zip_with(whole, part, lambda a, b: F.pmod(a - b, F.lit(POWER)))


def fingerprint(vector: Column) -> Column:
    """A vector as text: eight digits a lane."""
    return F.concat_ws("", F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of sentences that two texts have in common, 0 to 1."""
    more = F.element_at(a, 1) - F.element_at(b, 1)
    both = F.element_at(a, 1) + F.element_at(b, 1)
    signed = F.zip_with(
        F.slice(a, WIDTH + 2, SIGNS),
        F.slice(b, WIDTH + 2, SIGNS),
        lambda x, y: ((x - y) * 2 - more).cast("double"),
    )
    apart = F.aggregate(signed, F.lit(0.0), lambda n, x: n + x * x) / SIGNS
    return F.when(a == b, 1.0).when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def ranged(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``_range``: the higher the id, the higher the range; null ids have -1."""
    number = max(1, math.ceil(docs.count() / ROWS))
    borders = docs.approxQuantile(key, [i / number for i in range(1, number)], 0.1 / number) if number > 1 else []
    # One border below all ids keeps the bucketizer's least number of ranges.
    splits = [-math.inf, *sorted({-1e300, *borders}), math.inf]
    cut = Bucketizer(splits=splits, inputCol="_number", outputCol="_range", handleInvalid="keep")
    out = cut.transform(docs.withColumn("_number", F.col(key).cast("double"))).drop("_number")
    return out.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(F.col("_range")).cast("int"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with vector, next_text and next_vector, of the next row by descending key."""
    docs = ranged(docs.withColumn(text, F.coalesce(text, F.lit(""))), key).withColumn("_tie", F.xxhash64(text))
    firsts = docs.groupBy("_range").agg(F.max(F.struct(key, "_tie")).alias("_first"))
    around = Window.orderBy(F.desc("_range"))
    # One row a range: the range before each, the lowest one coming before the highest.
    places = materialize(
        firsts.withColumn("_to", F.coalesce(F.lag("_range").over(around), F.min("_range").over(Window.partitionBy()))),
        "ranges",
    )
    found = places.select("_range", "_to", F.col(f"_first.{key}").alias("_key"), F.col("_first._tie").alias("_tie"))
    ghosts = (
        docs.join(found, (docs["_range"] == found["_range"]) & docs[key].eqNullSafe(found["_key"]) & (docs["_tie"] == found["_tie"]), "left_semi")
        .dropDuplicates(["_range"])
        .join(found.select("_range", "_to"), "_range")
        .withColumn("_range", F.col("_to"))
        .drop("_to")
        .withColumn("_ghost", F.lit(True))
    )
    rows = docs.withColumn("_ghost", F.lit(False)).unionByName(ghosts).repartition("_range")
    rows = lanes(rows, text, "vector")
    order = Window.partitionBy("_range").orderBy("_ghost", F.desc_nulls_last(key), F.desc("_tie"))
    rows = rows.withColumns({"next_text": F.lead(text).over(order), "next_vector": F.lead("vector").over(order)})
    return rows.filter(~F.col("_ghost")).drop("_ghost", "_range", "_tie")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and their likenesses."""
    rows = with_next(docs.select("doc_id", "text")).withColumn("n_chars", F.length("text").cast("int"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("next_text", F.lit(1), half))
    rows = lanes(rows.withColumn("edited", edited).drop("next_text"), "edited", "edited_vector")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("vector")).alias("fingerprint"),
        fingerprint(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
