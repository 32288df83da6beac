"""Exact search for pairs of titles that share most of their character grams.

Two titles match when their raw titles carry the same numbers, both have enough grams, and
the Dice coefficient of their gram sets reaches the threshold.

Titles are compared in blocks. The titles of one set of numbers, if they are many, are dealt to
blocks of about ``GRAMS`` grams by the number of their grams; each two blocks whose titles are near
enough in size to match are one unit of work, and the few titles of all other numbers share units.
A unit has an index of the rarest grams of its titles, as many as some grams of any match must be
among, and meets only titles that share so many of them. Grams are also folded to parities of some
hundred bits; no more of these can differ than grams do, so most of what is left is refused by
counting bits, and the others gram by gram. Only pairs that match are written: what is shuffled is each title, once for each
block it may match in. The number of meetings still grows with the square of the number of titles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import MIN_GRAMS, SPACE, TITLE_GRAM, key_grams
from broadsheet.session import materialize

#: Entries in the list of most frequent grams.
TOP_GRAMS = 1024
#: Titles of the same numbers that one unit of work compares at most; more are cut into blocks.
BLOCK = 4096
#: Blocks that these are cut into at least, so that all tasks have some, and grams of a block, about.
SPREAD, GRAMS = 8, 1 << 22
#: What a title weighs in its block besides its grams.
EXTRA = 16
#: How many of the rarest grams are asked for in common at most; half of those of any match if these are fewer.
COMMON = 8
#: Bits for each gram that titles are compared by before grams are counted.
BITS = 8
#: Titles that show how many pairs of all match.
SOME = 1 << 14
#: Pairs that a unit of work holds before it gives them on.
HELD = 1 << 18
#: Values that are numbered by a table of all of them; others are sorted.
TABLE = 1 << 24


def title_nodes(titles: DataFrame) -> DataFrame:
    """(node, title_key, numbers) to comparable titles with their grams and the letters of these.

    The grams pass through a generator so that they are built once and not again in the
    filter on their number.
    """
    enough = F.filter(F.array(key_grams(F.col("title_key"))), lambda g: F.size(g) >= MIN_GRAMS)
    letters = F.regexp_replace("title_key", f"[{SPACE}]+", "").alias("letters")
    return titles.select("node", "numbers", letters, F.explode(enough).alias("grams")).withColumn(
        "n", F.size("grams")
    )


def _joined_grams(threshold: float) -> Column:
    """How many of its rarest grams a title must offer so that no match is missed."""
    shared = F.ceil(F.col("n") * threshold / (2 - threshold) - F.lit(1e-9))
    return (F.col("n") - F.greatest(shared, F.lit(1)) + 1).cast("int")


def postings(nodes: DataFrame, frequent: DataFrame, threshold: float) -> DataFrame:
    """(gram, node) rows of the grams that each title offers, the most frequent ones last."""
    entries = F.concat(
        F.array_sort(F.array_except("grams", "frequent")), F.array_intersect("frequent", "grams")
    )
    return (
        nodes.withColumn("frequent", frequent.scalar())
        .withColumn("joined", _joined_grams(threshold))
        .select(
            "node",
            "numbers",
            "n",
            (F.col("n") - F.col("joined")).alias("rest"),
            F.explode(F.slice(entries, 1, F.col("joined"))).alias("gram"),
        )
    )


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the distinct values, all below ``size``, and how many there are."""
    if size > TABLE:
        found, at = np.unique(values, return_inverse=True)
        return at, len(found)
    known = np.zeros(size, bool)
    known[values] = True
    return (np.cumsum(known) - 1)[values], int(known.sum())


def _gram_sets(letters: list[str], numbers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, gram) pairs in order; grams of different numbers differ."""
    sizes = np.array([len(t) for t in letters], np.int64)
    row = np.repeat(np.arange(len(letters)), sizes)
    points = np.frombuffer("".join(letters).encode("utf-32-le"), np.uint32)
    kind, n = _numbered(points, 0x110000)
    # A gram is a pair of pairs of letters, numbered each time, so that no two grams agree.
    for step in (1, 2):
        kind, n = _numbered(kind[:-step] * n + kind[step:], n * n)
    whole = np.flatnonzero(row[: 1 - TITLE_GRAM] == row[TITLE_GRAM - 1 :])
    row, kind = row[whole], kind[whole]
    group = np.unique(numbers, return_inverse=True)[1]
    if group.max():
        kind, n = _numbered(kind * (group.max() + 1) + group[row], n * (int(group.max()) + 1))
    pairs = np.sort(row * n + kind)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    return pairs // n, pairs % n


def _parities(row: np.ndarray, gram: np.ndarray, titles: int, words: int) -> np.ndarray:
    """Titles by words: each bit says whether the grams dealt to it are odd in number."""
    bits = 64 * words
    bit = (gram * 0x9E3779B1 >> 15) % bits
    out = np.empty((titles, words), np.uint64)
    step = max(1, (1 << 22) // bits)
    for a in range(0, titles, step):
        b = min(a + step, titles)
        one, two = np.searchsorted(row, [a, b])
        odd = np.bincount((row[one:two] - a) * bits + bit[one:two], minlength=(b - a) * bits) & 1
        out[a:b] = np.packbits(odd.astype(bool)).view(np.uint64).reshape(b - a, words)
    return out


def _reach(threshold: float) -> float:
    """How many times as many grams as the other one a title of a match can have."""
    return (2 - threshold) / threshold if 0 < threshold < 1 else 1.0 if threshold >= 1 else math.inf


def _matches(left: np.ndarray, right: np.ndarray | None, letters: list[str], numbers: list[str], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows that match it, scores) for the rows where ``left``, among those where ``right``;
    without ``right`` among the rows where ``left``, each two rows once."""
    row, gram = _gram_sets(letters, numbers)
    size = np.bincount(row, minlength=len(letters))
    start = np.r_[0, np.cumsum(size)]
    rarest = np.argsort(np.bincount(gram), kind="stable")
    rank = np.empty_like(rarest)
    rank[rarest] = np.arange(len(rank))
    gram = np.sort(row * len(rank) + rank[gram]) % len(rank)
    bits = _parities(row, gram, len(letters), max(1, math.ceil(size.mean() * BITS / 64)))
    mine, others = (s[np.argsort(size[s], kind="stable")] for s in map(np.flatnonzero, (left, left if right is None else right)))
    reach, least = _reach(threshold), min(size[mine[0]], size[others[0]])
    # A match shares so many grams at least, so this many of them are among the first of both titles,
    # the rarest ones, once that many and all that need not be shared are taken.
    need = np.maximum(np.ceil(threshold * (size + np.maximum(size / reach, least)) / 2 - 1e-9), 1).astype(np.int64)
    common = max(1, min(COMMON, int(need.min()) // 2))
    taken = np.minimum(size - need + common, size)
    place = np.full(len(letters), -1)
    place[others] = np.arange(len(others))
    index = np.flatnonzero((place[row] >= 0) & (np.arange(len(row)) - start[row] < taken[row]))
    ends = np.r_[0, np.cumsum(np.bincount(gram[index], minlength=len(rank)))].tolist()
    index = (np.sort(gram[index] * len(others) + place[row[index]]) % len(others)).astype(np.int32)
    own = np.zeros(len(rank), bool)
    for k, i in enumerate(mine.tolist()):
        met = np.concatenate([index[ends[g] : ends[g + 1]] for g in gram[start[i] : start[i] + taken[i]].tolist()])
        if len(met) < common:
            continue
        met.sort()
        hit = met[common - 1 :][met[common - 1 :] == met[: len(met) - common + 1]]
        if right is None:
            hit = hit[hit > k]
        if not len(hit):
            continue
        at = others[hit[np.r_[True, hit[1:] != hit[:-1]]]]
        # No more of the parities can differ than grams do.
        differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
        at = at[differ <= (1 - threshold) * (size[i] + size[at]) + 1e-6]
        if not len(at):
            continue
        n = size[at]
        last = np.cumsum(n)
        grams = gram[np.arange(last[-1]) + np.repeat(start[at] - (last - n), n)]
        mark = gram[start[i] : start[i + 1]]
        own[mark] = True
        shared = np.add.reduceat(own[grams], last - n, dtype=np.int64)
        own[mark] = False
        score = 2 * shared / (size[i] + n)
        keep = (score >= threshold) & (shared > 0)
        yield i, at[keep], score[keep]


def _blocks(offered: DataFrame, threshold: float) -> tuple[DataFrame, Column]:
    """For numbers of many titles and each number of grams: the first and last block of such titles,
    and of those that they may match; and the number of units that the titles of other numbers share."""
    sizes = offered.groupBy("numbers", "n").agg(F.count(F.lit(1)).alias("titles"))
    # A row for each number of grams, however many titles there are.
    same = Window.partitionBy("numbers")
    weight = F.col("titles") * (F.col("n") + EXTRA)
    many = sizes.withColumns({"all": F.sum("titles").over(same), "weight": weight, "whole": F.sum(weight).over(same)}).where(F.col("all") > BLOCK)
    before = F.sum("weight").over(same.orderBy("n")) - F.col("weight")
    block = F.least(F.lit(GRAMS), F.ceil(F.col("whole") / SPREAD))
    dealt = many.withColumns({"before": before, "block": block, "log": F.floor(F.log("n") * 1e6)}).withColumns(
        {"first": F.floor(F.col("before") / F.col("block")), "last": F.floor((F.col("before") + F.col("weight") - 1) / F.col("block"))}
    )
    steps = int(math.log(min(_reach(threshold), 1e9)) * 1e6) + 3
    near = same.orderBy("log").rangeBetween(-steps, steps)
    large = dealt.select("numbers", "n", "first", "last", F.min("first").over(near).alias("low"), F.max("last").over(near).alias("high"))
    alike = offered.groupBy("numbers").agg(F.count(F.lit(1)).alias("titles"))
    small = F.sum(F.when(F.col("titles") <= BLOCK, F.col("titles")))
    shelves = alike.agg(F.greatest(F.ceil(small / BLOCK), F.lit(1)).cast("bigint").alias("shelves"))
    return materialize(large, "blocks"), shelves.scalar()


def _placed(rows: DataFrame, large: DataFrame, shelves: Column, own: str, other: str | None) -> DataFrame:
    """Titles with the unit of work they are in: once for each block that they may match in.

    Without ``other`` a block meets each block once, itself included."""
    key = F.xxhash64("numbers")
    rows = rows.join(large, ["numbers", "n"], "left").select(
        "node",
        "numbers",
        "letters",
        F.when(F.col("first").isNull(), F.pmod(key, shelves)).otherwise(key).alias("shelf"),
        F.coalesce(F.col("first") + F.pmod(F.xxhash64("node"), F.col("last") - F.col("first") + 1), F.lit(0)).cast("int").alias("block"),
        F.explode(F.sequence(F.coalesce("low", F.lit(0)).cast("int"), F.coalesce("high", F.lit(0)).cast("int"))).alias("met"),
    )
    if other is None:
        return rows.withColumns({"one": F.least("block", "met"), "two": F.greatest("block", "met")}).drop("met")
    return rows.withColumnsRenamed({"block": own, "met": other}).withColumn("block", F.lit(0 if own == "one" else 1))


def matching_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(a_node, b_node, score) of matching titles; within ``left`` with a < b when right is None."""
    alone = right is None
    columns = ["node", "numbers", "letters", "n"]
    offered = left.select(columns) if alone else left.select(columns).unionByName(right.select(columns))
    large, shelves = _blocks(offered, threshold)
    if alone:
        placed = _placed(left, large, shelves, "one", None)
    else:
        placed = _placed(left, large, shelves, "one", "two").unionByName(_placed(right, large, shelves, "two", "one"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        node, block, one, two = (rows.column(c).to_numpy() for c in ("node", "block", "one", "two"))
        same = alone and one[0] == two[0]
        first, second = (block == b for b in ((one[0], two[0]) if alone else (0, 1)))
        if not first.any() or not second.any():
            return
        found, n = [], 0
        for i, at, score in _matches(first, None if same else second, rows.column("letters").to_pylist(), rows.column("numbers").to_pylist(), threshold):
            mine, theirs = np.full(len(at), node[i]), node[at]
            if alone:
                mine, theirs = np.minimum(mine, theirs), np.maximum(mine, theirs)
            if len(mine):
                found.append((mine, theirs, score))
                n += len(mine)
            if n > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a_node", "b_node", "score"])
                found, n = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a_node", "b_node", "score"])

    kind = left.schema["node"].dataType.simpleString()
    # Units of work are heavy for their bytes: they are dealt to all tasks and not drawn together.
    key = ["shelf", "one", "two"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, *key).groupBy(*key).applyInArrow(run, f"a_node {kind}, b_node {kind}, score double")


def pair_work(nodes: DataFrame, threshold: float) -> DataFrame:
    """Estimate of the gram meetings of matching pairs inside ``nodes``, as a one-row table.

    Many pairs come from families of near copies, which show among few titles as well: up to about
    ``SOME`` titles, chosen by hash, are compared, and their pairs stand for those of all."""
    titles, grams = nodes.agg(F.count(F.lit(1)), F.avg("n")).first()
    share = max(1, titles // SOME)
    some = nodes.where(F.pmod(F.xxhash64(F.lit("some"), "node"), F.lit(share)) == 0)
    return matching_pairs(some, None, threshold).agg((F.count(F.lit(1)) * (float(share) ** 2 * (grams or 0.0))).alias("work"))
