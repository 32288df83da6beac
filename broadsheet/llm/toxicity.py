"""Toxicity by non-negative positive-unlabelled learning over letter runs.

Confirmed toxic texts are the positives; all texts that may be learned from, confirmed ones
included, are the unlabelled ones, so that ``prior``, the share of toxic texts among them, is
the prior of that very set. The risk of a scorer is
``prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))``; where the
second part falls below zero, its gradient is turned round, so that the scorer unlearns what
it has only memorised.

Features are runs of ``LETTERS`` bytes of the lower-cased text, present or not, hashed to
``FEATURES`` places; only those that are several times as frequent among positives as among
other texts, and too frequent for chance, count. Their frequencies are a grouped aggregate
over all texts. The chosen features of all texts, equal sets counted once with their number,
are a written table; every step sums the gradient over its partitions, and only sums of the
length of the weights reach the driver. All documents are scored, over their whole texts.

Null and empty texts are scored by the bias alone. Without positives all scores are 0.
Every row gives one row; other columns are kept but for the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.words import LETTERS as BYTES
from broadsheet.llm.words import buffers, mix, sliced
from broadsheet.session import materialize
from broadsheet.sources.tables import table

LETTERS = 5
FEATURES = 1 << 18
#: How many times as frequent a feature is at least among positives, and how unlikely (as a
#: natural logarithm) that would be by chance.
LIFT, SURPRISE = 3.0, 15.0
STEPS, RATE, PENALTY = 400, 0.05, 1e-3
#: Partitions whose sums the driver takes as they are; more are summed in between.
SUMMED = 64
#: Bytes hashed at a time.
SLICE = 1 << 20


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts in place, quickly where they are in runs already."""
    values.sort(kind="stable" if values.itemsize == 8 else None)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, in order; only features that ``wanted`` is true for."""
    data, rows = buffers(column)
    found = []
    for lo in range(0, len(data), SLICE):
        part = BYTES[data[lo : lo + SLICE + LETTERS - 1]]
        n = len(part) - LETTERS + 1
        if n <= 0:
            break
        hashed = part[:n].copy()
        for k in range(1, LETTERS):
            hashed *= np.uint64(0x9E3779B97F4A7C15)
            hashed += part[k : k + n]
        place = (mix(hashed) & np.uint64(FEATURES - 1)).astype(np.int32)
        # The rows that have bytes here; a run of letters must end in its own row.
        first, last = np.searchsorted(rows, [lo, lo + n - 1], side="right") - 1
        ends = np.clip(rows[first + 1 : last + 2] - lo, 0, n)
        row = np.repeat(np.arange(last - first + 1, dtype=np.int32), np.diff(ends, prepend=0))
        inside = np.arange(n, dtype=np.int32) + np.int32(LETTERS) <= (rows[first + 1 : last + 2] - lo)[row]
        if wanted is not None:
            inside &= wanted[place]
        row, place = row[inside], place[inside]
        if last - first < (1 << 31) // FEATURES:
            # Small numbers sort faster.
            pairs = _distinct(row * np.int32(FEATURES) + place).astype(np.int64)
        else:
            pairs = np.sort(row.astype(np.int64) * FEATURES + place)
        found.append(pairs + first * FEATURES)
    # A row may go on in the next slice.
    pairs = _distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // FEATURES, pairs % FEATURES


def _frequencies(rows: DataFrame, text: str) -> DataFrame:
    """place -> number of positives and of other texts that have it; place -1 has all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in sliced(batches, text):
            positive = np.asarray(batch.column("_positive"), bool)
            row, place = features(batch.column(text))
            own = positive[row]
            counts += [np.bincount(place[own], minlength=FEATURES), np.bincount(place[~own], minlength=FEATURES)]
            texts += [positive.sum(), (~positive).sum()]
        full = np.flatnonzero(counts.any(axis=0))
        found = [np.r_[-1, full], *(np.r_[t, c[full]] for t, c in zip(texts, counts))]
        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["place", "seen", "other"])

    found = rows.mapInArrow(run, "place bigint, seen bigint, other bigint")
    return found.groupBy("place").agg(F.sum("seen").alias("seen"), F.sum("other").alias("other"))


def _telling(seen: np.ndarray, other: np.ndarray, positives: int, others: int) -> np.ndarray:
    """Which features are several times as frequent among positives, and not by chance."""
    due = np.maximum(other / others, 1 / others) * positives
    surprise = seen * np.log(np.maximum(seen, 1e-9) / due) - (seen - due)
    return (seen > 0) & (seen / positives >= LIFT * other / others) & (surprise >= SURPRISE)


#: Texts as (first entry of each, their entries, how often each is a positive, how often unlabelled).
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _block(texts: list[bytes], positive: np.ndarray, unlabelled: np.ndarray) -> Block:
    """Texts from their features as numbers of weights, 4 bytes each."""
    starts = np.cumsum([0, *(len(t) // 4 for t in texts)])
    return starts, np.frombuffer(b"".join(texts), np.int32), positive.astype(float), unlabelled.astype(float)


def _sums(block: Block, theta: np.ndarray, bias: float) -> np.ndarray:
    """Sums over positives and over unlabelled texts, a row each: of chance times feature, of the
    chance, and of the logarithm of its complement."""
    starts, at, *sides = block
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    chance = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[at], len(starts) - 1) + bias, -30, 30)))
    return np.array([np.r_[np.bincount(at, (n * chance)[row], len(theta)), n @ chance, n @ np.log1p(-chance)] for n in sides])


def _descended(sums: Callable[[np.ndarray, float], np.ndarray], seen: np.ndarray, positives: int, unlabelled: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias from the sums that each step asks for; ``seen`` counts positives by feature."""
    theta, bias = np.zeros(len(seen)), float(np.log(prior / (1 - prior)))
    share = np.r_[seen, positives] / positives
    first, second = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    for step in range(1, STEPS + 1):
        own, rest = sums(theta, bias) / np.array([[positives], [unlabelled]])
        # Logistic loss: the slope for target 1 is p - 1, for target 0 it is p.
        negative = rest[:-1] - prior * own[:-1]
        slope = prior * (own[:-1] - share) + negative if prior * own[-1] - rest[-1] >= 0 else -negative
        # A weight is held back by its feature's share, so that rare terms can tell as well.
        slope[:-1] += PENALTY * share[:-1] * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return theta, float(bias)


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias, from two local lists of texts."""
    weights = np.zeros(FEATURES)
    if not positives or not unlabelled:
        return weights, -50.0
    seen, other = (np.bincount(np.concatenate(t), minlength=FEATURES) for t in (positives, unlabelled))
    places = np.flatnonzero(_telling(seen, other, len(positives), len(unlabelled)))
    if not len(places):
        return weights, float(np.log(prior / (1 - prior)))
    number = np.full(FEATURES, -1, np.int32)
    number[places] = np.arange(len(places))
    texts = [number[t][number[t] >= 0].tobytes() for t in [*positives, *unlabelled]]
    side = np.arange(len(texts)) < len(positives)
    block = _block(texts, side, ~side)
    weights[places], bias = _descended(lambda t, b: _sums(block, t, b), seen[places], len(positives), len(unlabelled), prior)
    return weights, bias


def trained(rows: DataFrame, prior: float, text: str = "text") -> tuple[np.ndarray, float]:
    """Weights of all features and the bias; ``_positive`` tells the confirmed rows."""
    weights = np.zeros(FEATURES)
    counts = materialize(_frequencies(rows, text), "frequencies")
    total = counts.filter("place < 0").agg(F.sum("seen"), F.sum("other")).first()
    positives, others = total[0] or 0, total[1] or 0
    if not positives or not others:
        return weights, -50.0
    # At most FEATURES rows of numbers, whatever the number of texts.
    found = counts.filter("place >= 0 AND seen > 0").orderBy("place").toArrow()
    places, seen, other = (found[c].to_numpy() for c in ("place", "seen", "other"))
    own = _telling(seen, other, positives, others)
    places, seen = places[own], seen[own]
    if not len(places):
        return weights, float(np.log(prior / (1 - prior)))
    number = np.full(FEATURES, -1, np.int32)
    number[places] = np.arange(len(places))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            row, place = features(batch.column(text), number >= 0)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [number[place[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_positive"), pa.array(lists, pa.binary())], names=["_positive", "places"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, at, positive, unlabelled = _block(batch.column("places").to_pylist(), *(np.asarray(batch.column(c)) for c in ("positive", "unlabelled")))
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (starts, at, positive, unlabelled)], names=["a", "b", "c", "d"])

    sets = rows.mapInArrow(chosen, "_positive boolean, places binary").groupBy("places")
    sets = sets.agg(F.sum(F.col("_positive").cast("long")).alias("positive"), F.count(F.lit(1)).alias("unlabelled"))
    sets = materialize(sets.sortWithinPartitions("places"), "learned")
    kinds = (np.int64, np.int32, float, float)
    blocks = sets.mapInArrow(packed, "a binary, b binary, c binary, d binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    depth = 1 if blocks.getNumPartitions() <= SUMMED else 2

    def sums(theta: np.ndarray, bias: float) -> np.ndarray:
        def part(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            out = np.zeros((2, len(theta) + 2))
            for row in rows:
                out += _sums(tuple(np.frombuffer(b, k) for b, k in zip(row, kinds)), theta, bias)
            yield out

        return blocks.mapPartitions(part).treeReduce(np.add, depth)

    weights[places], bias = _descended(sums, seen, positives, positives + others, prior)
    blocks.unpersist()
    return weights, bias


def scored(docs: DataFrame, positives: DataFrame, learnable: Column, prior: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``score``: the chance of being toxic.

    ``positives`` holds the keys of confirmed toxic texts; rows with ``learnable`` true are
    learned from, and ``prior`` is the share of toxic texts among them.
    """
    positives = positives.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_positive", F.lit(True))
    # Written, so that the optimizer knows the size of the keys when it joins them.
    rows = docs.filter(learnable).select(key, text).join(materialize(positives, "positives"), key, "left")
    rows = rows.select(F.coalesce("_positive", F.lit(False)).alias("_positive"), text)
    weights, bias = trained(rows, min(max(prior, 0.01), 0.9), text)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kept = [c for c in docs.columns if c not in (text, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, start = model.value
        wanted = theta != 0
        for batch in sliced(batches, text):
            row, place = features(batch.column(text), wanted)
            logit = np.bincount(row, theta[place], batch.num_rows) + start
            score = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    return docs.select(*kept, text).mapInArrow(run, docs.select(*kept).schema.add("score", "double"))


def _held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held out or not, score and decision."""
    rows = docs.select("doc_id", "text", _held_out(F.col("doc_id")).alias("held_out"))
    known = labels.filter(~_held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    # The labelled share of toxic texts among the documents that are learned from, each once.
    judged = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    prior = judged.join(rows.filter(~F.col("held_out")).select("doc_id"), "doc_id", "left_semi").agg(F.avg("toxic")).first()[0] or 0.0
    found = scored(rows, known.filter("toxic = 1"), ~F.col("held_out"), prior)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), table(spark, folder, "labels"))
