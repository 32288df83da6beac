"""A folder of landed bodies as a source, in batch and as a stream.

A fetcher leaves each body as one file, ``<folder>/r-<run>/s-<source>/<pos>-<status>-<seconds>.body``,
with run and source escaped as in a URL and the fetch time in seconds. The file begins with a
line break, which is not part of the body: file scans pass over files without any bytes, and
a failed fetch without a body must still be seen. Both readers list the files with the engine's
binary source: a batch takes the files of one run or of all, a stream those that its log does
not hold yet. Files of other names are no bodies.

A text has at least one UTF-16 unit per three bytes, so a file of more than three times the cap
is refused by its length alone: the filter reaches the scan and the file is never opened. What
is left is measured exactly by the parsers. Bytes that are no UTF-8 are replaced, as fetching
clients do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.feeds import MAX_BODY

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
_NAME = r"/r-([^/]*)/s-([^/]*)/([0-9]{1,9})-([0-9]{1,9})-([0-9]{1,12})\.body$"


def _escaped(name: Column) -> Column:
    return F.replace(F.url_encode(name), F.lit("*"), F.lit("%2A"))


def land(landing: DataFrame, folder: str) -> int:
    """Write the bodies of ``landing`` (run_id, source, fetched_at, status, body, and body_pos
    where a source has several) and return their number.

    A file gets its name when it is whole, and a task that runs again writes the same names.
    Bodies without a run, source, status or time are not landed; a null body is empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{root}/{name}"
                parent, _, last = path.rpartition("/")
                store.create_dir(parent, recursive=True)
                with store.open_output_stream(f"{parent}/.{last}") as out:
                    out.write(b"\n")
                    out.write(body.as_buffer())
                store.move(f"{parent}/.{last}", path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    pos = F.coalesce("body_pos", F.lit(0)) if "body_pos" in landing.columns else F.lit(0)
    name = F.concat(
        F.lit("r-"), _escaped(F.col("run_id")), F.lit("/s-"), _escaped(F.col("source")), F.lit("/"),
        pos.cast("string"), F.lit("-"), F.col("status").cast("string"), F.lit("-"),
        F.unix_seconds("fetched_at").cast("string"), F.lit(".body"),
    )
    body = F.coalesce(F.col("body").cast("binary"), F.lit(b""))
    named = landing.select(name.alias("name"), body.alias("body")).where("name IS NOT NULL")
    return named.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _bodies(files: DataFrame, max_body: int) -> DataFrame:
    most = 3 * max_body
    text = F.substring("content", 2, most).cast("string")
    read = files.where(F.col("length") <= most + 1).select(
        "path", F.make_valid_utf8(text).alias("body"), F.lit(None).cast("string").alias("error")
    )
    size = F.col("length") - 1
    refused = files.where(F.col("length") > most + 1).select(
        "path", F.lit(None).cast("string").alias("body"),
        F.format_string("response too large: %d bytes > %d", size, F.lit(most)).alias("error"),
    )
    part = lambda i: F.regexp_extract("path", _NAME, i)
    return read.unionAll(refused).where(F.col("path").rlike(_NAME)).select(
        F.url_decode(part(1)).alias("run_id"),
        F.url_decode(part(2)).alias("source"),
        part(3).cast("int").alias("body_pos"),
        part(4).cast("int").alias("status"),
        F.timestamp_seconds(part(5).cast("bigint")).alias("fetched_at"),
        "body",
        "error",
    )


def read_bodies(spark: SparkSession, folder: str, run_id: str | None = None, max_body: int = MAX_BODY) -> DataFrame:
    """The landed bodies of one run, or of all: (run_id, source, body_pos, status, fetched_at,
    body, error). Only the folder of the run is listed."""
    path = folder
    if run_id is not None:
        path = f"{folder}/r-{spark.range(1).select(_escaped(F.lit(run_id))).first()[0]}"
    files = spark.read.schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.body")
    return _bodies(files.format("binaryFile").load(path), max_body)


def stream_bodies(spark: SparkSession, folder: str, max_body: int = MAX_BODY, files_per_batch: int | None = None) -> DataFrame:
    """The same rows as a stream over all runs; each file comes once."""
    files = spark.readStream.schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.body")
    if files_per_batch:
        files = files.option("maxFilesPerTrigger", files_per_batch)
    return _bodies(files.format("binaryFile").load(folder), max_body)
