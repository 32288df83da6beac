"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark.

1. Words of the training rows are counted. The sorted table of their 64-bit hashes is
   written in ranges; a word's number is its row.
2. A pair is the number of its first word in the upper, of its second in the lower half of
   64 bits. Tasks count their own pairs and send them, sorted, as one block a shard. A shard
   is a range of pairs that holds about ``SHARD`` tokens, as the words' counts tell, so a
   frequent first word is split over several shards. Each shard becomes a sorted file.
3. Counts of counts give the discounts; per first word the total and the numbers of pairs
   seen once, twice and more often, per second word the number of different first words.
4. Scoring tasks map the files and look up their distinct pairs in ascending order.

The driver sees one line a file. Files stand below the shared folder.

A text's tokens are its words and one end. Null and empty texts have the end alone. Without
training rows every token has the chance 1. Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.arrays import Run, Sorted, write
from broadsheet.llm.shipping import received, shared
from broadsheet.llm.words import SPACES, mix, sliced, word_hashes
from broadsheet.session import work_path
from broadsheet.sources.tables import table

#: Tokens of a shard, words of a range of per-word figures, tokens a task counts at a time.
SHARD = 1 << 21
RANGE = 1 << 20
BUFFER = 1 << 21
END = mix(np.array([0x0E], np.uint64))[0]

WORDS = ("i8", "i8", "i8")  # hash, count, tokens before it in its file
PAIRS = ("i8", "u4")  # pair, count
FIRST = ("i8", "i8", "u4", "u4", "u4")  # number, total, pairs seen once, twice, more often
SECOND = ("i8", "u4")  # number, different first words


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with an end after each row, and where rows begin."""
    hashes, rows = word_hashes(column, SPACES)
    return np.insert(hashes, rows[1:], END).view(np.int64), rows + np.arange(len(rows))


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values))


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as gaps, byte by byte: the high bytes are zeros and compress away."""
    gaps = np.diff(keys, prepend=0)
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1))


class Vocabulary(Sorted):
    """Words by hash; ``number`` of the end of all is the mark before a text."""

    def __init__(self, folder: str, runs: list[Run], sums: list[int], texts: int):
        super().__init__(folder, runs)
        self.size, self.total, self.texts = int(self.starts[-1]), int(sum(sums)), texts
        by_first = dict(zip((r.first for r in runs), sums))
        self.before = np.cumsum([0, *(by_first[r.first] for r in self.runs)])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(hashes, return_inverse=True)
        return self.find(distinct)[back]

    def passed(self, numbers: np.ndarray) -> np.ndarray:
        """Tokens of all smaller words."""
        run = np.clip(np.searchsorted(self.starts, numbers, side="right") - 1, 0, len(self.runs) - 1)
        inside = numbers < self.size
        out = self.take(np.where(inside, numbers, -1), 2) + self.before[run]
        return np.where(inside, out, self.total)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < self.size, self.take(np.where(numbers < self.size, numbers, -1), 1), self.texts)

    def shards(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of ascending pairs; it never falls."""
        share = self.passed(second) / max(1, self.total)
        names, back = np.unique(first, return_inverse=True)
        at = self.passed(names)[back] + self.counts(names)[back] * share
        return (at // SHARD).astype(np.int64)


def _count_words(docs: DataFrame, text: str, folder: str) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["word", "n"])

        for b in sliced(batches, 0):
            held.append(_tokens(b.column(0))[0])
            n += len(held[-1])
            if n > BUFFER:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if sum(len(w) for w, _ in parts):
            words, counts = (np.concatenate(p) for p in zip(*parts))
            name = write(folder, [words, counts, np.cumsum(counts) - counts])
            ends = int(counts[words == END.view(np.int64)].sum())
            yield pa.RecordBatch.from_pylist([{"first": int(words[0]), "rows": len(words), "name": name, "total": int(counts.sum()), "texts": ends}])

    counted = docs.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    ranged = counted.repartitionByRange("word").sortWithinPartitions("word")
    files = ranged.mapInArrow(store, "first bigint, rows bigint, name string, total bigint, texts bigint").collect()
    runs = [Run(f["first"], f["rows"], f["name"], WORDS) for f in files]
    return Vocabulary(folder, runs, [f.total for f in files], sum(f.texts for f in files))


def _pairs(numbers: np.ndarray, rows: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second word of every token's pair."""
    first = np.empty_like(numbers)
    first[1:] = numbers[:-1]
    first[rows[:-1]] = start
    return first, numbers


def _count_pairs(docs: DataFrame, text: str, folder: str, words: Vocabulary) -> tuple[list[Run], np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(folder, *received(parts))
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shards = known.shards(keys >> 32, keys & 0xFFFFFFFF)
            cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(keys)]
            spans = list(zip(cuts[:-1], cuts[1:]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(shards[a]) for a, _ in spans], pa.int64()),
                    pa.array([_packed(keys[a:b]) for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
                ],
                names=["shard", "pairs", "counts"],
            )

        for b in sliced(batches, 0):
            hashes, rows = _tokens(b.column(0))
            first, second = _pairs(known.numbers(hashes), rows, known.size)
            held.append(first << 32 | second)
            n += len(second)
            if n > BUFFER:
                yield batch()
                held, n = [], 0
        if n:
            yield batch()

    def merge(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked(v.as_py()) for v in rows.column("pairs")])
        counts = np.concatenate([np.frombuffer(v.as_py(), np.uint32) for v in rows.column("counts")])
        keys, counts = _grouped(keys, counts.astype(np.int64))
        if counts.max() >= 1 << 32:
            raise OverflowError("a pair occurs more often than its column can hold")
        name = write(folder, [keys, counts.astype(np.uint32)])
        often = np.bincount(np.minimum(counts, 5), minlength=6)
        return pa.table({"first": [int(keys[0])], "rows": [len(keys)], "name": [name], "often": [often[1:5].tolist()]})

    parts = shared(docs.sparkSession.sparkContext, (words.runs, [int(x) for x in np.diff(words.before)], words.texts))
    blocks = docs.select(text).mapInArrow(count, "shard bigint, pairs binary, counts binary")
    files = blocks.groupBy("shard").applyInArrow(merge, "first bigint, rows bigint, name string, often array<bigint>").collect()
    return [Run(f["first"], f["rows"], f["name"], PAIRS) for f in files], sum((np.array(f.often) for f in files), np.zeros(4, np.int64))


def _word_figures(spark: SparkSession, folder: str, runs: list[Run]) -> tuple[list[Run], list[Run], np.ndarray, int]:
    """Files of per-first and per-second figures, and how often second words have 1 to 4
    first words and how often they have any more."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, name in zip(*(c.to_pylist() for c in b.columns)):
                pairs = Sorted(folder, [Run(first, rows, name, PAIRS)])
                keys, counts = pairs._columns(0)
                n = counts.astype(np.int64)
                firsts = _grouped(keys >> 32, n, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64))
                seconds = _grouped(keys & 0xFFFFFFFF, np.ones(len(keys), np.int64))
                for kind, columns in (("first", firsts), ("second", seconds)):
                    ranges = columns[0] // RANGE
                    cuts = np.r_[0, np.flatnonzero(np.diff(ranges)) + 1, len(ranges)]
                    spans = list(zip(cuts[:-1], cuts[1:]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(spans)),
                            pa.array([int(ranges[a]) for a, _ in spans], pa.int64()),
                            pa.array([_packed(columns[0][a:b]) for a, b in spans], pa.binary()),
                            pa.array([np.stack([c[a:b] for c in columns[1:]]).view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in spans], pa.binary()),
                        ],
                        names=["kind", "range", "numbers", "values"],
                    )

    def merge(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        width = 4 if kind == "first" else 1
        keys = np.concatenate([_unpacked(v.as_py()) for v in rows.column("numbers")])
        raw = [np.ascontiguousarray(np.frombuffer(v.as_py(), np.uint8).reshape(8, -1).T).view(np.int64).reshape(width, -1) for v in rows.column("values")]
        keys, *values = _grouped(keys, *np.concatenate(raw, axis=1))
        types = FIRST if kind == "first" else SECOND
        name = write(folder, [keys, *(v.astype(t) for v, t in zip(values, types[1:]))])
        often = np.bincount(np.minimum(values[0], 5), minlength=6)[1:].tolist() if kind == "second" else []
        return pa.table({"kind": [kind], "first": [int(keys[0])], "rows": [len(keys)], "name": [name], "often": pa.array([often], pa.list_(pa.int64()))})

    listed = spark.createDataFrame([(r.first, r.rows, r.name) for r in runs], "first bigint, rows bigint, name string").repartition(max(1, len(runs)))
    blocks = listed.mapInArrow(figures, "kind string, range bigint, numbers binary, values binary")
    files = blocks.groupBy("kind", "range").applyInArrow(merge, "kind string, first bigint, rows bigint, name string, often array<bigint>").collect()
    firsts = [Run(f["first"], f["rows"], f["name"], FIRST) for f in files if f.kind == "first"]
    seconds = [Run(f["first"], f["rows"], f["name"], SECOND) for f in files if f.kind == "second"]
    often = sum((np.array(f.often) for f in files if f.kind == "second"), np.zeros(5, np.int64))
    return firsts, seconds, often[:4], int(often[4]) + int(often[2:4].sum())


def discounts(often: np.ndarray) -> np.ndarray:
    """What counts of 1, 2 and more lose, from how many have the counts 1 to 4."""
    n = np.maximum(often.astype(float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([min(max(d, 0.0), float(k)) if often[k - 1] else 0.0 for k, d in enumerate(found, 1)])


class Model:
    """Chances of texts from the mapped files; one per task."""

    def __init__(self, folder: str, words, pairs, firsts, seconds, pair_often, word_often, word_more):
        self.words = Vocabulary(folder, *words)
        self.pairs, self.firsts, self.seconds = Sorted(folder, pairs), Sorted(folder, firsts), Sorted(folder, seconds)
        self.pair_loss, self.word_loss = (np.r_[0.0, discounts(o)] for o in (pair_often, word_often))
        self.kinds = max(1, int(self.pairs.starts[-1]))
        self.left = float((self.word_loss[1:] * [word_often[0], word_often[1], word_more]).sum()) / self.kinds

    def _single(self, number: np.ndarray) -> np.ndarray:
        """The chance of words by the number of different words before them."""
        n = self.seconds.take(self.seconds.find(number), 1)
        kept = (n - self.word_loss[np.minimum(n, 3)]) / self.kinds
        return kept + (self.left if self.pairs.starts[-1] else 1.0) / (self.words.size + 1)

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base score, score."""
        hashes, rows = _tokens(column)
        words = self.words
        distinct, back = np.unique(hashes, return_inverse=True)
        number = words.find(distinct)
        count = words.take(number, 1)
        base = np.log10((count + 1) / (words.total + words.size + 1))
        # Unknown words share one number behind all others and the mark before a text.
        number = np.where(number < 0, words.size + 1, number)
        order = np.argsort(number, kind="stable")
        single = np.empty(len(number))
        single[order] = self._single(number[order])
        first, second = _pairs(number[back], rows, words.size)
        keys, where = np.unique(first << 32 | second, return_inverse=True)
        n = self.pairs.take(self.pairs.find(keys), 1)
        contexts, at = np.unique(keys >> 32, return_inverse=True)
        found = self.firsts.find(contexts)
        total, *seen = (self.firsts.take(found, c)[at] for c in (1, 2, 3, 4))
        spread = sum(d * s for d, s in zip(self.pair_loss[1:], seen))
        sure = np.maximum(total, 1)
        kept = (n - self.pair_loss[np.minimum(n, 3)]) / sure
        rest = np.where(total > 0, spread / sure, 1.0)
        chance = kept[where] + rest[where] * single[back]
        sums = lambda v: np.add.reduceat(v, rows[:-1]) if len(v) else np.zeros(0)
        return np.diff(rows), sums((count[back] > 0).astype(np.int64)), sums(base[back]), sums(np.log10(chance))


def scored(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score;
    the model learns from the rows for which ``training`` is true."""
    spark = docs.sparkSession
    folder = work_path(spark, "lm")
    learned = docs.filter(training)
    words = _count_words(learned, text, folder)
    pairs, pair_often = _count_pairs(learned, text, folder, words) if words.size else ([], np.zeros(4, np.int64))
    firsts, seconds, word_often, word_more = _word_figures(spark, folder, pairs)
    parts = (words.runs, [int(x) for x in np.diff(words.before)], words.texts)
    model = shared(spark.sparkContext, (folder, parts, pairs, firsts, seconds, pair_often, word_often, word_more))
    total = words.total
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c != text and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*received(model))
        for b in sliced(batches, text):
            n, seen, base, score = known.score(b.column(text))
            values = [pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(n), total), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *values], names=[*kept, *added])

    schema = docs.select(*kept).schema
    for name in added:
        schema = schema.add(name, "double" if name.endswith("score") else "long")
    return docs.select(*kept, text).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: held out or not, tokens, base score and score."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    return scored(rows, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
