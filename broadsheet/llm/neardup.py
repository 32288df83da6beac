"""Near-duplicate documents by SetSketch registers: band, estimate, verify, connect.

1. Every whole text becomes its set of distinct word shingles and a sketch of REGISTERS
   registers. Documents with equal sets form one class; the class goes on as one set.
2. Classes that agree on all registers of a band share a bucket. At a similarity of 0.8 two
   sets miss all BANDS buckets with a chance of 5e-8.
3. Star rounds: each class of a bucket meets the bucket's pivot, the least class of another
   component. Pairs that the joint likelihood of their sketches leaves open are verified on
   the full sets, and verified links join components. A pivot has then met all others of its
   buckets and leaves them. Rounds go on while they find links in more than ``FRUITFUL`` of
   their pairs.
4. What is left of buckets that still hold several components is compared whole, in blocks
   inside tasks: by the parity of the shingles in each of 4,096 places, which bounds the
   number of different shingles from below, and by the sketches. Only pairs of different
   components that both leave open come out, each from the first band it shares. They are
   verified, too, so no pair that shares a bucket is left untested, while a large group of
   copies never becomes pairs.

Nothing but counts reaches the driver; every round reads tables from the shared folder.

Classes are numbered; a row is known by its id and the hash of its text, so rows that share an
id but not a text are documents of their own, each linked by its own text.

Null, empty and wordless texts have empty sets and link with nothing. Documents without an
id take no part in links and have no component. Every row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.setsketch import REGISTERS, bands, may_reach, parity, registers, shingle_sets
from broadsheet.llm.words import SPACES, sliced, word_hashes
from broadsheet.operators.graphs import components
from broadsheet.session import materialize
from broadsheet.sources.tables import table

FRUITFUL = 0.01
#: Sketches of a block that one task compares with another.
BLOCK = 2048


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))


def _rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, hash, text): what tells rows of one id apart is the hash of their text."""
    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))


def sketched(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, hash, n_shingles, digest, sketch, bands) of each row; digest is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            sets = shingle_sets(*word_hashes(batch.column(2), SPACES), size)
            sketches = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sketches], pa.binary()),
                    _lists(bands(sketches)),
                ],
                names=["id", "hash", "n_shingles", "digest", "sketch", "bands"],
            )

    kind = docs.schema[key].dataType.simpleString()
    columns = f"id {kind}, hash bigint, n_shingles bigint, digest binary, sketch binary, bands array<bigint>"
    return _rows_of(docs, key, text).mapInArrow(run, columns)


def _sets(classes: DataFrame, size: int) -> DataFrame:
    """(id, shingles, parity) of the classes (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = shingle_sets(*word_hashes(batch.column(1), SPACES), size)
            columns = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "shingles", "parity"])

    return classes.select("id", "text").mapInArrow(run, "id bigint, shingles binary, parity binary")


def _sides(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both ends' columns of ``values`` (id, ...) as a_... and b_...."""
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in values.columns if c != "id")), side)
    return pairs


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def open_pairs(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that sizes and the likelihood of their sketches leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.names.index
                sizes = [batch.column(at(f"{s}_n_shingles")).to_numpy() for s in "ab"]
                keep = may_reach(*(_rows(batch.column(at(f"{s}_sketch"))) for s in "ab"), *sizes, least)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    values = classes.select("id", "n_shingles", "sketch")
    sided = _sides(pairs, values)
    sided = sided.filter(F.least("a_n_shingles", "b_n_shingles") >= F.greatest("a_n_shingles", "b_n_shingles") * (least - 1e-9))
    return sided.mapInArrow(run, pairs.select("a", "b").schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least ``percent`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, sets.select("id", "shingles")).select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, pairs.select("a", "b").schema)


def _in_blocks(crossed: DataFrame, classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of different labels that share a bucket and that their sketches leave open."""

    def run(rows: pa.Table) -> pa.Table:
        ids, labels, sizes = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "label", "n_shingles"))
        side = rows.column("block").to_numpy()
        first, other, band = rows.column("one")[0].as_py(), rows.column("two")[0].as_py(), rows.column("band")[0].as_py()
        sketches = _rows(rows.column("sketch").combine_chunks())
        keys = bands(sketches).view(np.int64)
        odd = np.frombuffer(b"".join(rows.column("parity").to_pylist()), np.uint64).reshape(len(ids), -1)
        place = int(np.flatnonzero(keys[0] == band)[0])
        # The rows of the most frequent label need not start a comparison.
        names, counts = np.unique(labels, return_counts=True)
        a, b = [], []
        rare = labels != names[counts.argmax()]
        for i in np.flatnonzero(rare):
            with_ = side == (other if side[i] == first else first)
            # Two rows off the frequent label meet from the smaller id only.
            with_ &= (labels != labels[i]) & (~rare | (ids > ids[i]))
            j = np.flatnonzero(with_)
            j = j[np.minimum(sizes[j], sizes[i]) >= np.maximum(sizes[j], sizes[i]) * (least - 1e-9)]
            # Sets differ in at least as many shingles as their parities do in bits.
            apart = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1)
            j = j[apart <= (1 - least) / (1 + least) * (sizes[j] + sizes[i]) + 1e-9]
            j = j[~(keys[j, :place] == keys[i, :place]).any(axis=1)]
            if len(j):
                same = np.broadcast_to(sketches[i], (len(j), REGISTERS))
                j = j[may_reach(same, sketches[j], np.full(len(j), sizes[i]), sizes[j], least)]
            a.append(np.full(len(j), ids[i]))
            b.append(ids[j])
        empty = np.zeros(0, ids.dtype)
        return pa.table({"a": pa.array(np.concatenate([empty, *a])), "b": pa.array(np.concatenate([empty, *b]))})

    counts = crossed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    counts = materialize(counts, "blocks")
    kind = crossed.schema["id"].dataType.simpleString()
    placed = crossed.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("one"), F.greatest("block", o).alias("two"))))
    met = placed.withColumn("_pair", others).select("band", "id", "label", "block", "_pair.*")
    met = met.join(classes.select("id", "n_shingles", "sketch"), "id").join(sets.select("id", "parity"), "id")
    return met.groupBy("band", "one", "two").applyInArrow(run, f"a {kind}, b {kind}")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after joining the components that the links (a, b) connect."""
    ends = _sides(links, labels).select(F.col("a_label").alias("u"), F.col("b_label").alias("v"))
    found = components(ends).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    joined = labels.join(found, "label", "left")
    return materialize(joined.select("id", F.coalesce("_new", "label").alias("label")), "labels")


def _crossed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (band, id, label) of buckets that hold several labels, with the bucket's pivot: the
    least (label, id)."""
    labelled = buckets.join(labels, "id")
    mixed = labelled.groupBy("band").agg(F.min(F.struct("label", "id")).alias("pivot"), F.max("label").alias("_last"))
    mixed = materialize(mixed.filter(F.col("pivot.label") < F.col("_last")).drop("_last"), "mixed")
    return labelled.join(mixed, "band")


def _components(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """(id, hash, n_shingles, root) of each row of ``docs``: ``root`` is the least (id, hash) of
    the row's component, null for rows without words or id."""
    least = percent / 100
    all_ = materialize(sketched(docs, size, key, text), "sketches")
    classes = (
        all_.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("id", "hash")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    )
    # The numbers are read from the written table alone, so they stay what they are.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    banded = classes.select(F.explode("bands").alias("band"), "id")
    several = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"))
    several = materialize(several.filter("n > 1").select("band", "pivot"), "bands")
    buckets = materialize(banded.join(several, "band"), "buckets")
    met = materialize(buckets.select("id").distinct(), "met")
    shown = classes.join(met, "id").select(F.col("id").alias("class"), F.col("row.id").alias("id"), F.col("row.hash").alias("hash"))
    texts = _rows_of(docs, key, text).join(shown, ["id", "hash"]).select(F.col("class").alias("id"), "text")
    sets = materialize(_sets(texts, size).dropDuplicates(["id"]), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        return materialize(verified(open_pairs(pairs, classes, least), sets, percent), "links")

    labels = met.withColumn("label", F.col("id"))
    # The first round takes one pivot a class; copies of one text mostly share it.
    pairs = buckets.filter("id <> pivot").groupBy("id").agg(F.min("pivot").alias("b")).select(F.col("id").alias("a"), "b")
    links = links_of(pairs)
    if not links.isEmpty():
        labels = _relabelled(labels, links)
    buckets = buckets.drop("pivot")
    while True:
        crossed = materialize(_crossed(buckets, labels), "crossed")
        pairs = crossed.filter(F.col("label") != F.col("pivot.label")).select(F.col("id").alias("a"), F.col("pivot.id").alias("b"))
        pairs = materialize(pairs.distinct(), "pairs")
        tested = pairs.count()
        if not tested:
            break
        links = links_of(pairs)
        new = links.count()
        if new:
            labels = _relabelled(labels, links)
        buckets = crossed.filter(F.col("id") != F.col("pivot.id")).select("band", "id")
        if new <= FRUITFUL * tested:
            crossed = materialize(_crossed(buckets, labels).drop("pivot"), "crossed")
            links = links_of(materialize(_in_blocks(crossed, classes, sets, least), "pairs"))
            if not links.isEmpty():
                labels = _relabelled(labels, links)
            break
    members = labels.join(classes.select("id", "row"), "id")
    roots = members.groupBy("label").agg(F.min("row").alias("root"))
    members = members.select("id", "label").join(roots, "label").select("id", "root")
    groups = classes.select("digest", "id", "row").join(members, "id", "left")
    groups = materialize(groups.select("digest", F.coalesce("root", "row").alias("root")), "groups")
    joined = all_.select("id", "hash", "n_shingles", "digest").join(groups, "digest", "left")
    return joined.select("id", "hash", "n_shingles", F.when(F.col("id").isNotNull(), F.col("root")).alias("root"))


def linked(docs: DataFrame, size: int = 4, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row of ``docs``: the least id of its component."""
    found = _components(docs, size, percent, key, text)
    return found.select(F.col("id").alias(key), "n_shingles", F.coalesce("root.id", "id").alias("component_id"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that of the least id, and of several texts under this id
    the one of the least hash. Rows that agree in id and text stay once. Documents without an id
    stay, as do those without words."""
    found = _components(docs, size, percent, key, text).filter(F.col("id").isNotNull())
    gone = F.col("root.id").isNotNull() & ((F.col("id") != F.col("root.id")) | (F.col("hash") != F.col("root.hash")))
    rows = found.groupBy("id", "hash").agg(F.first(gone).alias("gone"), F.count(F.lit(1)).alias("n")).filter("gone OR n > 1")
    rows = materialize(rows, "duplicates")

    def those(condition: str, how: str) -> DataFrame:
        named = rows.filter(condition).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
        return kept.join(named, (kept[key] == named["_id"]) & (F.xxhash64(kept[text]) == named["_hash"]), how)

    kept = docs
    kept = those("gone", "left_anti")
    if rows.filter("NOT gone").isEmpty():
        return kept
    return those("NOT gone", "left_anti").unionAll(those("NOT gone", "left_semi").dropDuplicates([key, text]))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: set size, component and whether it is the one that stays."""
    return linked(docs.select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))


#: The same rows by an inverted index of shingles and a recursive walk over the links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS root FROM d
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.root < links.b
), c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
