"""Language ID by Bayesian fusion of a text's letters with what stands around it.

The evidence on a document's language is

* its text: a naive Bayes model over runs of ``LETTERS`` bytes, of which a text counts as at
  most ``WEIGHT`` independent ones;
* its declared language, right with a chance that is learned: the declarations of all documents
  are held against their texts, in a histogram of ``BINS`` bins, until the chance settles;
* its host's prior: counts of languages by host, smoothed by those of its address suffix,
  those by the counts of all documents, each with ``SMOOTH`` documents' weight.

All counts are grouped aggregates over all documents, taken from a narrow table of scores that
is written once; those of hosts join back by host, where a frequent host is split at run time.
The driver sees the histogram and one count per language. The text model is fitted on about
``BOUND`` labelled texts, equally many of each language as far as it has them, chosen by a hash
of their ids; it holds ``FEATURES`` numbers a language.

Null, empty and letterless texts give no text evidence and are rejected, as are documents
whose best language is less likely than ``LEAST``, and texts whose letters are ``ODDS`` less
likely in every language than in a background in which all runs are equally likely, whatever
is declared. A null or unknown declaration is no
evidence, a null host has the suffix ''. Every row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.shipping import received, shared
from broadsheet.llm.words import LETTERS as BYTES
from broadsheet.llm.words import SYMBOLS, buffers, mix, sliced
from broadsheet.session import materialize
from broadsheet.sources.tables import table

LETTERS = 3
FEATURES = 1 << 14
BOUND = 20_000
WEIGHT = 40.0
SMOOTH = 20.0
#: What is thought of declarations before any is seen: as much as of TRUSTED ones, so many of
#: them right. No declaration is surer than SURE.
TRUSTED, TRUST, SURE, BINS = 10.0, 0.9, 0.999, 1000
LEAST = 0.5
#: By how much the background's log likelihood must exceed every language's to reject a text;
#: a few unseen words in a short text do not reach it.
ODDS = 20.0
SLICE = 1 << 20


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and features of all letter runs, a slice of the texts at a time. Digits and signs
    count as gaps, so that only letters tell."""
    data, rows = buffers(column)
    gap = SYMBOLS.copy()
    gap[0x30:0x3A] = True
    letters = np.where(gap, np.uint64(0), BYTES)
    for lo in range(0, len(data), SLICE):
        part = letters[data[lo : lo + SLICE + LETTERS - 1]]
        n = len(part) - LETTERS + 1
        if n <= 0:
            break
        hashed, filled = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        for k in range(LETTERS):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + part[k : k + n]
            filled += part[k : k + n] != 0
        at = np.flatnonzero(filled > 1)
        row = np.searchsorted(rows, at + lo, side="right") - 1
        inside = at + lo + LETTERS <= rows[row + 1]
        yield row[inside], (mix(hashed[at[inside]]) % np.uint64(FEATURES)).astype(np.int64)


class TextModel:
    """Log chances of letter runs by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts + 0.5
        self.chances = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)) if languages else counts

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each language (rows by languages), and the number of runs."""
        n = len(column)
        total, number = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for row, place in _runs(column):
            number += np.bincount(row, minlength=n)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, self.chances[k][place], n)
        return total / np.maximum(1.0, number / WEIGHT)[:, None], number


def fitted(texts: DataFrame, language: str = "lang", text: str = "text", key: str = "doc_id", bound: int = BOUND) -> TextModel:
    """The text model of at most about ``bound`` of the rows that name their language, shared
    equally among the languages."""
    named = texts.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    named = named.select(F.col(language).cast("string").alias("language"), F.col(text).alias("text"), F.xxhash64(key, F.lit(8)).alias("place"))
    sizes = materialize(named.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "named")
    share = F.lit(bound / max(1, sizes.count())) / F.col("n")
    # A hash is a number from -1 to 1 in units of 2^63.
    drawn = (share >= 1) | (F.col("place") / float(1 << 63) < 2 * share - 1)
    chosen = named.join(sizes, "language").filter(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            names, which = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            counts = np.zeros((len(names), FEATURES), np.int64)
            for row, place in _runs(batch.column(1)):
                counts += np.bincount(which[row] * FEATURES + place, minlength=counts.size).reshape(counts.shape)
            for k, name in enumerate(names):
                full = np.flatnonzero(counts[k])
                yield pa.RecordBatch.from_arrays(
                    # Also a language without letters is known.
                    [pa.array([name] * (len(full) + 1)), pa.array(np.r_[-1, full]), pa.array(np.r_[0, counts[k][full]])],
                    names=["language", "place", "n"],
                )

    found = chosen.select("language", "text").mapInArrow(run, "language string, place bigint, n bigint")
    rows = found.groupBy("language", "place").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.language for r in rows})
    counts, at = np.zeros((len(languages), FEATURES)), {name: k for k, name in enumerate(languages)}
    for r in rows:
        if r.place >= 0:
            counts[at[r.language], r.place] = r.n
    return TextModel(languages, counts)


def text_evidence(docs: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_text`` (log likelihoods) and ``_runs``."""
    sent = shared(docs.sparkSession.sparkContext, model)
    kept = [c for c in docs.columns if c not in (text, "_text", "_runs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            scores, number = received(sent).score(batch.column(text))
            ends = pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, pa.array(number)], names=[*kept, "_text", "_runs"])

    from pyspark.sql.types import ArrayType, DoubleType

    schema = docs.select(*kept).schema.add("_text", ArrayType(DoubleType())).add("_runs", "long")
    return docs.select(*kept, text).mapInArrow(run, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    return F.transform(logs, lambda x: F.exp(x - top))


def _normal(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda n, v: n + v)
    return F.transform(values, lambda v: v / total)


def _counts(rows: DataFrame, number: int, *by: str) -> DataFrame:
    """Expected documents of each language by ``by``, in ``counts``."""
    sums = [F.sum(F.element_at("_chance", k + 1)).alias(f"_{k}") for k in range(number)]
    return rows.groupBy(*by).agg(*sums).select(*by, F.array(*(f"_{k}" for k in range(number))).alias("counts"))


def reliability(chances: list[tuple[float, int]], number: int) -> float:
    """How often declarations are right, from the chances that their texts alone give them and
    how many declarations have each: the expected share, taken again until it settles."""
    chance, often = np.array(chances, float).reshape(-1, 2).T
    right = TRUST
    for _ in range(200):
        hit = right * chance
        hit = hit / (hit + (1 - right) * (1 - chance) / max(1, number - 1))
        new = min(SURE, float((often @ hit + TRUSTED * TRUST) / (often.sum() + TRUSTED)))
        if abs(new - right) < 1e-12:
            break
        right = new
    return right


def _reliability(scores: DataFrame, languages: Column, number: int) -> float:
    stated = scores.filter(F.col("_heard") & (F.array_position(languages, F.col("declared")) > 0))
    chance = F.element_at(_normal(_softmax(F.col("_text"))), F.array_position(languages, F.col("declared")).cast("int"))
    bins = stated.select(chance.alias("chance")).groupBy(F.floor(F.col("chance") * BINS)).agg(F.avg("chance"), F.count(F.lit(1)))
    return reliability(sorted((r[1], r[2]) for r in bins.collect()), number)


def identified(docs: DataFrame, model: TextModel, declared: Column | None = None, host: Column | None = None, text: str = "text", right: float | None = None) -> DataFrame:
    """``docs`` without its text, with language, chance, text_language and rejected.

    ``declared`` names a language, ``host`` is where the document comes from; its suffix is
    what follows its last full stop. ``right`` is the chance that a declaration is right; it
    is learned if it is not given.
    """
    number = len(model.languages)
    languages = F.array(*map(F.lit, model.languages)) if number else F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    rows = docs.withColumns({"declared": none if declared is None else declared, "_host": F.coalesce(none if host is None else F.lower(host), F.lit(""))})
    rows = rows.withColumn("_suffix", F.substring_index("_host", ".", -1))
    scores = text_evidence(rows, model, text)
    if not number:
        return scores.select(*[c for c in docs.columns if c != text], none.alias("language"), F.lit(0.0).alias("chance"), none.alias("text_language"), F.lit(True).alias("rejected"))
    # Documents without letters say nothing about their host.
    scores = materialize(scores.withColumn("_heard", F.col("_runs") > 0), "languages")
    right = _reliability(scores, languages, number) if right is None else right
    wrong = (1 - right) / max(1, number - 1)
    stated = F.transform(
        languages,
        lambda name: F.when(~F.coalesce(F.array_contains(languages, F.col("declared")), F.lit(False)), 0.0)
        .when(name == F.col("declared"), float(np.log(right)))
        .otherwise(float(np.log(wrong or 1e-9))),
    )
    own = F.zip_with("_text", stated, lambda a, b: a + b)
    scores = scores.withColumn("_own", own)
    heard = scores.filter("_heard").select("_host", "_suffix", _normal(_softmax(F.col("_own"))).alias("_chance"))
    hosts = materialize(_counts(heard, number, "_host", "_suffix"), "hosts")
    # Sums of sums: suffixes and all documents are counted from the hosts.
    above = hosts.select("_suffix", F.col("counts").alias("_chance"))
    suffixes = materialize(_counts(above, number, "_suffix"), "suffixes")
    top = _counts(suffixes.select(F.col("counts").alias("_chance")), number).first().counts
    prior = _normal(F.array(*(F.lit((n or 0.0) + 1) for n in top)))
    smooth = lambda counts, above: _normal(F.zip_with(counts, above, lambda n, p: n + SMOOTH * p))
    places = hosts.join(suffixes.withColumnRenamed("counts", "_suffix_counts"), "_suffix")
    places = places.select("_host", smooth(F.col("counts"), smooth(F.col("_suffix_counts"), prior)).alias("_prior"))
    joined = scores.join(materialize(places, "places"), "_host", "left")
    logs = F.zip_with("_own", F.coalesce("_prior", prior), lambda a, p: a + F.log(p))
    joined = joined.withColumn("_final", _normal(_softmax(logs)))
    best = F.array_max("_final")
    # The background's log likelihood, of as many runs as a text counts for.
    background = F.least(F.col("_runs").cast("double"), F.lit(WEIGHT)) * float(-np.log(FEATURES))
    return joined.select(
        *[c for c in docs.columns if c != text],
        "declared",
        F.element_at(languages, F.array_position("_final", best).cast("int")).alias("language"),
        best.alias("chance"),
        F.when(F.col("_heard"), F.element_at(languages, F.array_position("_text", F.array_max("_text")).cast("int"))).alias("text_language"),
        (~F.col("_heard") | (best < LEAST) | (F.array_max("_text") < background - ODDS)).alias("rejected"),
    )


_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def markup_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of its markup, entities decoded; the markup also gives
    ``declared``."""
    schema = pages.drop(html, "text", "declared").schema.add("text", "string").add("declared", "string")
    kept = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stated = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", re.I)
        for batch in sliced(batches, html):
            raw = [v or "" for v in batch.column(html).to_pylist()]
            found = [stated.search(v) for v in raw]
            texts = [unescape(_HIDDEN.sub(" ", v)).replace("\xa0", " ").encode("utf-8", "replace").decode() for v in raw]
            names = [m[1].lower() if m else None for m in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(names, pa.string())], names=schema.names)

    return pages.select(*kept, html).mapInArrow(run, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page, by a text model fitted on labelled documents."""
    model = fitted(table(spark, folder, "documents"))
    host = F.regexp_extract("url", r"://([^/?#:]*)", 1)
    pages = markup_text(table(spark, folder, "pages").select("page_id", F.coalesce(host, F.lit("")).alias("host"), "html"))
    found = identified(pages.withColumnRenamed("declared", "stated"), model, F.col("stated"), F.col("host"))
    return found.select("page_id", "host", "declared", "text_language", "language", F.round("chance", 9).alias("chance"), "rejected")
