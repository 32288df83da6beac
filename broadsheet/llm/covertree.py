"""Vector codes by Lloyd's rounds over cover trees, in whole numbers.

Vectors are cut into parts of equal length, each part has a codebook of its own. A task cuts
its vectors into chunks of up to ``CHUNK`` and grows a cover tree over each part of a chunk:
a node's points lie within its scale of its centre, its children's centres are more than half
that scale apart, and their scale is half. A subtree is a stretch of one order of the points,
so running sums over that order give its sum. The trees are written once, to the shared
folder, and serve all rounds.

In a round a node drops every entry that the triangle inequality puts behind another one for
all its points. With one entry left the whole subtree goes to that entry; other nodes hand
what is left to their children, down to leaves of equal points, which are compared exactly.
Distances are whole numbers; only the dropping uses roots, with a margin, so nothing depends on
rounding. The codebooks, of fixed size, are all that passes the driver.

Rows whose vector is null, or holds null or non-finite components or such as are beyond
``REACH`` (their distances would not fit a long), are dropped; so are rows whose vector is
empty, cannot be cut into parts or has another length than the smallest id's. Ids that repeat
give as many rows; null ids come last in the codebooks' first entries. Fewer rows than entries
give a smaller codebook. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from broadsheet.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors under one tree. A chunk of 64 numbers a vector takes about 30 MB while it grows.
CHUNK = 16_384
#: Components are below this size; squares of differences then add up within a long.
REACH = 1 << 19
#: What a distance may be wrong by, relative to its size.
MARGIN = 1e-9
NODES = ("start", "end", "radius", "low", "high")


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers; null where one of them is null, not finite or too large."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < REACH))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def _spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stretches of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def grow(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Cover trees over ``points`` (parts, vectors, numbers), all parts at once.

    Gives the order of the points and the nodes: their stretch of the order, the square of
    their radius, and their children (numbers of nodes). The first point of a stretch is the
    node's centre, the first nodes are the parts' roots.
    """
    parts, n, width = points.shape
    flat = points.reshape(-1, width)
    order = np.arange(parts * n)
    start = np.arange(parts) * n
    radius = np.maximum.reduceat(_squares(flat, np.repeat(flat[start], n, axis=0)), start)
    nodes = {"start": [start], "end": [start + n], "radius": [radius], "low": [np.zeros(parts, np.int64)], "high": [np.zeros(parts, np.int64)]}
    first, last, far = start, start + n, radius
    number, made = np.arange(parts), parts
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scale = 2.0 ** np.ceil(np.log2(np.sqrt(max(1.0, float(radius.max(initial=0))))))
    while True:
        some = far > 0
        first, last, far, number = first[some], last[some], far[some], number[some]
        if not len(first):
            break
        scale /= 2
        wide = far > scale * scale
        if wide.any():
            sizes = (last - first)[wide]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.repeat(first[wide], sizes) + _spans(sizes)
            here = flat[order[at]]
            child, gap = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            left, turn = np.arange(len(at)), 0
            while len(left):
                mine = owner[left]
                heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                centre = here[np.repeat(left[heads], np.diff(np.r_[heads, len(left)]))]
                squares = _squares(here[left], centre)
                near = squares <= scale * scale
                child[left[near]], gap[left[near]] = turn, squares[near]
                left, turn = left[~near], turn + 1
            moved = np.lexsort((child, owner))
            order[at] = order[at[moved]]
            owner, child, gap = owner[moved], child[moved], gap[moved]
            cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (child[1:] != child[:-1])])
            begin, reach = at[cuts], np.maximum.reduceat(gap, cuts)
            finish = begin + np.diff(np.r_[cuts, len(at)])
            own = owner[cuts]
            low = made + np.searchsorted(own, np.arange(len(sizes)))
            high = made + np.searchsorted(own, np.arange(len(sizes)), side="right")
            links.append((number[wide], low, high))
            for name, value in zip(NODES, (begin, finish, reach, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64))):
                nodes[name].append(value)
            fresh = made + np.arange(len(own))
            made += len(own)
            first, last, far, number = (np.r_[a[~wide], b] for a, b in ((first, begin), (last, finish), (far, reach), (number, fresh)))
            ranked = np.argsort(first, kind="stable")
            first, last, far, number = first[ranked], last[ranked], far[ranked], number[ranked]
    out = {name: np.concatenate(values) for name, values in nodes.items()}
    for parent, low, high in links:
        out["low"][parent], out["high"][parent] = low, high
    return order, out


def assign(root: int, centres: np.ndarray, nodes: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subtrees of a part's tree (numbers of nodes, in the order of their points) and the
    entry of each; ``centres`` are all nodes' centres."""
    distinct = np.unique(book, axis=0, return_index=True)[1]  # equal entries: the first wins
    entry = np.sort(distinct)
    node = np.full(len(entry), root)
    settled, winners = [], []
    while len(node):
        squares = _squares(centres[node], book[entry])
        cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[cuts, len(node)])
        least = np.minimum.reduceat(squares, cuts)
        radius = nodes["radius"][node[cuts]]
        bound = np.where(radius > 0, ((np.sqrt(least) + 2 * np.sqrt(radius)) * (1 + MARGIN)) ** 2 * (1 + MARGIN), least)
        near = squares <= np.repeat(bound, sizes)
        kept = np.add.reduceat(near.astype(np.int64), cuts)
        # At a leaf, of equally near entries the first one wins.
        done = (kept == 1) | (radius == 0)
        node, entry = node[near], entry[near]
        heads = np.cumsum(kept) - kept
        settled.append(node[heads[done]])
        winners.append(entry[heads[done]])
        open_ = np.flatnonzero(~done)
        parent = node[heads[open_]]
        low, children = nodes["low"][parent], nodes["high"][parent] - nodes["low"][parent]
        child = np.repeat(low, children) + _spans(children)
        begin, length = np.repeat(heads[open_], children), np.repeat(kept[open_], children)
        node = np.repeat(child, length)
        entry = entry[np.repeat(begin, length) + _spans(length)]
    found, won = np.concatenate(settled), np.concatenate(winners)
    ranked = np.argsort(nodes["start"][found])
    return found[ranked], won[ranked]


def _packed(chunk: pa.Table, parts: int) -> dict[str, object]:
    numbers = chunk.column("_numbers").combine_chunks()
    n = len(numbers)
    points = numbers.flatten().to_numpy().reshape(n, parts, -1).transpose(1, 0, 2)
    order, nodes = grow(points)
    return {
        "keys": chunk.column("_key").to_pylist(),
        "labels": chunk.column("_label").to_pylist(),
        "points": points.astype(np.int32).tobytes(),
        "order": order.astype(np.int32).tobytes(),
        **{name: nodes[name].astype(np.int64).tobytes() for name in NODES},
    }


class Chunk:
    """A written chunk's points, by the order of its trees, and nodes."""

    def __init__(self, row: dict, parts: int):
        self.order = np.frombuffer(row["order"], np.int32)
        self.n = len(self.order) // parts
        self.points = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(len(self.order), -1)
        self.sorted = self.points[self.order]
        self.nodes = {name: np.frombuffer(row[name], np.int64) for name in NODES}
        self.centres = self.sorted[self.nodes["start"]]

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry: sum and number of the points assigned to it."""
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        running = np.zeros((len(self.sorted) + 1, self.sorted.shape[1]), np.int64)
        np.cumsum(self.sorted, axis=0, out=running[1:])
        for part, book in enumerate(books):
            found, won = assign(part, self.centres, self.nodes, book)
            start, end = self.nodes["start"][found], self.nodes["end"][found]
            np.add.at(total[part], won, running[end] - running[start])
            np.add.at(count[part], won, end - start)
        return total, count

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector: its entries (vectors, parts) and the sum of its squared distances."""
        out, error = np.empty((len(books), self.n), np.int64), np.zeros(self.n, np.int64)
        for part, book in enumerate(books):
            found, won = assign(part, self.centres, self.nodes, book)
            sizes = self.nodes["end"][found] - self.nodes["start"][found]
            mine = slice(part * self.n, (part + 1) * self.n)
            out[part, self.order[mine] - part * self.n] = np.repeat(won, sizes)
            error += _squares(self.points[mine], book[out[part]])
        return out.T, error


def _trees(rows: DataFrame, parts: int, chunk: int) -> DataFrame:
    """One row per chunk: ids, labels, points, order and nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_packed(pa.Table.from_batches(held), parts)], schema=wanted)

        for batch in batches:
            while size + batch.num_rows >= chunk:
                held.append(batch.slice(0, chunk - size))
                batch = batch.slice(chunk - size)
                yield row()
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield row()

    key, label = rows.schema["_key"].dataType, rows.schema["_label"].dataType
    fields = [T.StructField("keys", T.ArrayType(key)), T.StructField("labels", T.ArrayType(label))]
    schema = T.StructType(fields + [T.StructField(name, T.BinaryType()) for name in ("points", "order", *NODES)])
    wanted = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks moved to the means, rounded down, of what is assigned to their entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                sums, n = Chunk(row, parts).sums(books)
                total += sums
                count += n
        place = np.arange(parts * entries * width)
        number = np.repeat(count.reshape(-1), width)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)), pa.array(number)], names=["place", "total", "number"])

    sums = trees.select("points", "order", *NODES).mapInArrow(run, "place long, total long, number long")
    found = sums.groupBy("place").agg(F.sum("total").alias("total"), F.sum("number").alias("number")).collect()
    out = books.copy().reshape(-1)
    for place, total, number in found:
        if number:
            out[place] = total // number
    return out.reshape(books.shape)


def _coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                codes, error = Chunk(one.select(["points", "order", *NODES]).to_pylist()[0], parts).codes(books)
                text = ["".join(c) for c in digits[codes].tolist()]
                yield pa.RecordBatch.from_arrays([one.column("keys").flatten(), one.column("labels").flatten(), pa.array(text), pa.array(error)], names=["_key", "_label", "code", "error"])

    key, label = (trees.schema[c].dataType.elementType for c in ("keys", "labels"))
    schema = T.StructType([T.StructField("_key", key), T.StructField("_label", label)]).add("code", "string").add("error", "long")
    return trees.mapInArrow(run, schema)


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (key, label, code, error), and the codebooks (parts, entries,
    numbers). A code has two hexadecimal digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("a code holds up to 256 entries a part")
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), whole(F.col(vector), scale).alias("_numbers"))
    rows = rows.filter((F.size("_numbers") > 0) & (F.size("_numbers") % parts == 0))
    by = [F.col("_key").asc_nulls_last(), F.col("_numbers")]
    length = next((len(r[0]) for r in rows.orderBy(*by).select("_numbers").limit(1).collect()), parts)
    rows = rows.filter(F.size("_numbers") == length)
    first = [r[0] for r in rows.orderBy(*by).select("_numbers").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    trees = materialize(_trees(rows, parts, chunk), "trees")
    for _ in range(rounds if len(first) else 0):
        books = _round(trees, books)
    coded = materialize(_coded(trees, books), "codes")
    return coded.select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error"), books


def digest(books: np.ndarray) -> str:
    """Digest of all numbers of the codebooks in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.schema("vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").parquet(f"{folder}/embeddings.parquet")
    rows, books = compressed(vectors)
    # Labels are few or many: the optimizer sees the size of their sums when they are made.
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
