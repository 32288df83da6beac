"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

A phrase is ``size`` consecutive words of a test item, or a shorter item as a whole. Each
task cuts its documents into shards of about ``SHARD`` words (a longer document is a shard
of its own) and indexes what can match: words that no phrase has become stops, and so does
a stretch shorter than every phrase. Backward search finds the range of each phrase, the
sampled suffixes give its places, and overlapping places merge into removal spans.

Items are searched in blocks of about ``BLOCK`` words, the bound of what is broadcast; more
items mean more searches in the same pass over the documents, not larger ones. No shuffle.

Null and empty texts have no words, no spans and no items; items without words match
nothing; equal items are all reported; null item ids are reported as ''. Every row gives one
row. Other columns are kept, columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.fmindex import FMIndex
from broadsheet.llm.shipping import received, shared
from broadsheet.llm.words import SYMBOLS, sliced, word_hashes
from broadsheet.sources.tables import table

WINDOW = 10
SHARD = 2_000_000
BLOCK = 2_000_000

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The distinct phrases of a block of items, as rows of hashes, with their items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        rows, self.owners, self.ids = {}, [], [i for i, _ in items]
        for item, (_, words) in enumerate(items):
            for at in range(max(1, len(words) - size + 1)) if len(words) else ():
                row = rows.setdefault(words[at : at + size].tobytes(), len(rows))
                self.owners.append((row, item))
        self.sizes = np.array([len(r) // 8 for r in rows], np.int64)
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in items)]))
        self.symbols = np.zeros((len(rows), size), np.int64)
        for row, key in enumerate(rows):
            self.symbols[row, : len(key) // 8] = np.searchsorted(self.words, np.frombuffer(key, np.uint64)) + 1
        owners = np.array(sorted(set(self.owners)), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(owners[:, 0], np.arange(len(rows) + 1))
        self.owners = owners[:, 1]


def _indexed(hashes: np.ndarray, rows: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """A shard's text for the index: symbols with a zero after each stretch, and the places
    of its words in the shard (-1 for zeros)."""
    found = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    inside = phrases.words[found] == hashes
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = rows[:-1][rows[:-1] < len(hashes)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(np.r_[~inside | begins, True])
    ends = stops[np.searchsorted(stops, starts, side="right")]
    long = ends - starts >= phrases.sizes.min()
    starts, sizes = starts[long], (ends - starts)[long]
    shift = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    place = np.full(len(text), -1, np.int64)
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = np.repeat(starts, sizes) + offset
    text[np.repeat(shift, sizes) + offset] = found[where] + 1
    place[np.repeat(shift, sizes) + offset] = where
    return text, place


def search(hashes: np.ndarray, rows: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """A shard's hit words (a flag each) and its pairs of row and item."""
    hit, pairs = np.zeros(len(hashes), bool), np.zeros((0, 2), np.int64)
    if not len(hashes) or not len(phrases.sizes):
        return hit, pairs
    text, place = _indexed(hashes, rows, phrases)
    if not len(text):
        return hit, pairs
    index = FMIndex(text, len(phrases.words))
    low, high = index.search(phrases.symbols, phrases.sizes)
    count = high - low
    total = int(count.sum())
    phrase = np.repeat(np.arange(len(low)), count)
    at = place[index.locate(np.repeat(low - np.cumsum(count) + count, count) + np.arange(total))]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + phrases.sizes[phrase], 1)
    hit = np.cumsum(edge[:-1]) > 0
    row = np.searchsorted(rows, at, side="right") - 1
    met = np.unique(row * len(phrases.sizes) + phrase)
    row, phrase = met // len(phrases.sizes), met % len(phrases.sizes)
    owners = phrases.first[phrase + 1] - phrases.first[phrase]
    item = phrases.owners[np.repeat(phrases.first[phrase] - np.cumsum(owners) + owners, owners) + np.arange(int(owners.sum()))]
    return hit, np.unique(np.c_[np.repeat(row, owners), item], axis=0)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without(column: pa.Array, spans: list[list[dict]]) -> pa.Array:
    """The texts without their spans of words."""
    texts = column.to_pylist()
    for i, own in enumerate(spans):
        if own:
            raw = texts[i].encode()
            words = [m.span() for m in _WORD.finditer(raw)]
            out, at = [], 0
            for span in own:
                out.append(raw[at : words[span["start"]][0]])
                at = words[span["end"] - 1][1]
            texts[i] = b"".join([*out, raw[at:]]).decode()
    return pa.array(texts, pa.string())


def _shard(batches: list[pa.RecordBatch], text: str, phrases: Phrases, cut: bool) -> Iterator[pa.RecordBatch]:
    parts = [word_hashes(b.column(text), SYMBOLS) for b in batches]
    shifts = np.cumsum([0, *(len(h) for h, _ in parts)])
    hashes = np.concatenate([h for h, _ in parts])
    rows = np.concatenate([[0], *(r[1:] + s for (_, r), s in zip(parts, shifts))])
    hit, pairs = search(hashes, rows, phrases)
    edges = np.diff(np.r_[False, hit, False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # A run of hit words may go on into the next document: cut it there.
    cuts = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(hit))]
    cuts = np.unique(cuts[hit[cuts - 1] & hit[cuts]]) if len(cuts) else cuts
    starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    first = np.searchsorted(starts, rows)
    items = np.searchsorted(pairs[:, 0], np.arange(len(rows)))
    done = 0
    for batch in batches:
        n = batch.num_rows
        old = [c.to_pylist() for c in batch.columns[-2:]] if batch.schema.names[-1] == "items" else None
        spans, names = [], []
        for i in range(done, done + n):
            own = [(int(a - rows[i]), int(b - rows[i])) for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
            ids = {phrases.ids[k] for k in pairs[items[i] : items[i + 1], 1]}
            if old:
                own = _merged(own + [(s["start"], s["end"]) for s in old[0][i - done]])
                ids |= {*old[1][i - done]}
            spans.append([{"start": a, "end": b} for a, b in own])
            names.append(sorted(ids))
        kept = list(batch.columns[:-3] if old else batch.columns)
        if cut:
            at = batch.schema.names.index(text)
            kept[at] = _without(kept[at], spans)
        labels = batch.schema.names[:-3] if old else batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(np.diff(rows[done : done + n + 1]), pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))],
            names=[*labels, *(f.name for f in ADDED)],
        )
        done += n


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", size: int = WINDOW, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, spans (hit words, merged, end exclusive) and items (ids); with
    ``cut`` the texts come without their spans."""
    docs = docs.drop(*({f.name for f in ADDED} - {text}))
    schema = T.StructType([*docs.schema, *ADDED])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = word_hashes(batch.column(1), SYMBOLS)
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "words"])

    known = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    known = known.mapInArrow(words, "id string, words array<bigint>")
    total = known.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    for block in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == block).collect()
        found = sorted(((r.id, np.array(r.words, np.int64).view(np.uint64)) for r in rows), key=lambda item: item[0])
        phrases = shared(docs.sparkSession.sparkContext, Phrases(found, size))

        last = cut and block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, last=last) -> Iterator[pa.RecordBatch]:
            held, bytes_held = [], 0
            for batch in sliced(batches, text):
                held.append(batch)
                bytes_held += batch.column(text).nbytes
                if bytes_held > 6 * SHARD:
                    yield from _shard(held, text, received(phrases), last)
                    held, bytes_held = [], 0
            if held:
                yield from _shard(held, text, received(phrases), last)

        docs = docs.mapInArrow(run, schema)
    return docs


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: counts of words, hit words and items, and a digest of the item ids."""
    found = contamination(docs.select("doc_id", "text"), items)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: The same rows by joining windows as strings.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)
), occ AS (SELECT doc_id, item_id, dw.k, p FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
