"""A training corpus from raw documents: five stages, each a table written and read again.

The stages, in order: reject what has no recognisable language, keep one document of each
group of near copies, cut passages of the benchmark, mask live credentials, and encode the
texts. All but the last return the columns of ``documents``.

Null texts carry no language and are rejected; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import decontaminate, language, neardup, pieces, secrets
from broadsheet.session import configure, materialize
from broadsheet.sources.tables import table


def identify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language shows; their own label is the declaration, their source the
    host. The text model is fitted on the labelled documents of the folder."""
    model = language.fitted(table(spark, folder, "documents"))
    keyed = docs.withColumns({"_key": F.xxhash64("doc_id", "text", "source", "lang"), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    rows = keyed.select("_id", "_key", "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    found = language.identified(rows, model, F.col("_lang"), F.col("_source"))
    gone = materialize(found.filter("rejected").select("_id", "_key").distinct(), "rejected")
    return keyed.join(gone, ["_id", "_key"], "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return neardup.deduplicated(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the passages that they share with the benchmark."""
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"), cut=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with live credentials masked."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Per document: its ids, their number, and digests of the ids and the decoded text."""
    import public_tokenizers

    coded = pieces.coded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _configured(stage: Stage) -> Stage:
    """The stage under the library's session settings, as batches bounded in bytes."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        return stage(configure(spark), docs, folder)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _configured(identify)),
    ("minhash_neardup", _configured(near_duplicates)),
    ("benchmark_decontamination", _configured(without_benchmark)),
    ("secret_scan", _configured(without_secrets)),
    ("sentencepiece", _configured(encode)),
]

#: The language model and the sketches have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
