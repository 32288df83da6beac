import hashlib
import math
import random

import llm_paths  # noqa: F401
import numpy as np
import pytest
from texts import frame

from broadsheet.llm import covertree as C

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Plain assignment in Python's whole numbers."""
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in kept[:entries]))]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = cut(v)[p]
                groups.setdefault(nearest(part, book)[1], []).append(part)
            for i, members in groups.items():
                book[i] = tuple(sum(c) // len(members) for c in zip(*members))
    out = []
    for k, v, label in kept:
        found = [nearest(part, book) for part, book in zip(cut(v), books)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
    return out, books


def vectors(seed, n, width=8, spread=0.2):
    pick = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(pick.gauss(0, spread)) for _ in range(width)], pick.choice([1, 2, None])) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1], 7) for i in range(n // 3)]


@pytest.mark.parametrize("chunk", [7, 100, 16_384])
def test_equals_plain_assignment(spark, chunk):
    rows = vectors(5, 300)
    random.Random(1).shuffle(rows)
    got, books = C.compressed(frame(spark, rows, SCHEMA).repartition(3), parts=4, entries=16, rounds=3, chunk=chunk)
    want, plain = brute(rows, 4, 16, 3)
    assert sorted((r.vec_id, r.code, r.error, r.label) for r in got.collect()) == sorted(want, key=lambda r: r[0])
    assert books.tolist() == [[list(e) for e in b] for b in plain]


def test_ties_and_repeats(spark):
    """Equal first entries, vectors in the middle between entries, and ids that repeat."""
    f = lambda *v: [x / 256 for x in v]
    rows = [(0, f(0, 0), 1), (1, f(0, 0), 1), (2, f(2, 4), 1), (3, f(1, 2), 2), (3, f(1, 2), 2), (4, f(-1, -2), None), (None, f(1, 2), None)]
    got, _ = C.compressed(frame(spark, rows, SCHEMA), parts=1, entries=3, rounds=1)
    want, _ = brute(rows, 1, 3, 1)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bad_vectors_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(2, 20, 4)
    bad = [None, [], [0.1, None, 0.2, 0.3], [nan, 0.0, 0.0, 0.0], [0.0, -inf, 0.0, 0.0], [1.0] * 3, [1.0] * 8, [1e30] * 4]
    rows = [(1000 + i, v, 1) for i, v in enumerate(bad)] + good
    got, _ = C.compressed(frame(spark, rows, SCHEMA), parts=2, entries=5)
    assert sorted(r.vec_id for r in got.collect()) == sorted(r[0] for r in good)
    none, books = C.compressed(frame(spark, [(1, None, 1)], SCHEMA))
    assert none.count() == 0 and books.size == 0 and none.columns == ["vec_id", "label", "code", "error"]


def test_trees_hold_what_they_promise():
    points = np.random.default_rng(3).integers(-200, 200, (3, 500, 4))
    points[:, 100:150] = points[:, :1]
    order, nodes = C.grow(points)
    flat = points.reshape(-1, 4)[order]
    assert sorted(order.tolist()) == list(range(1500))
    for i, (start, end, radius, low, high) in enumerate(zip(*(nodes[n].tolist() for n in C.NODES))):
        gaps = ((flat[start:end] - flat[start]) ** 2).sum(axis=1)
        assert gaps.max() == radius
        assert (low == high) == (radius == 0)
        if low < high:
            assert nodes["start"][low] == start and nodes["end"][high - 1] == end
            centres = flat[nodes["start"][low:high]]
            apart = [((a - b) ** 2).sum() for j, a in enumerate(centres) for b in centres[:j]]
            assert min(apart) > nodes["radius"][low:high].max()


def test_most_subtrees_are_assigned_whole():
    points = np.random.default_rng(4).normal(0, 300, (1, 20_000, 2)).astype(np.int64)
    order, nodes = C.grow(points)
    book = np.random.default_rng(5).integers(-600, 600, (16, 2))
    found, won = C.assign(0, points.reshape(-1, 2)[order][nodes["start"]], nodes, book)
    leaves = (nodes["radius"] == 0).sum()
    assert len(found) < leaves / 2
    sizes = nodes["end"][found] - nodes["start"][found]
    exact = ((points[0][order][:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    assert (np.repeat(won, sizes) == exact).all()


def test_query_over_the_table(spark):
    from conftest import SMALL

    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    want, books = brute(rows, 16, 64, 2)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in C.query(spark, SMALL).collect()}
    assert got == {(k, code, error, sums[label], digest) for k, code, error, label in want}
