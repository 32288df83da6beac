import random

import llm_paths  # noqa: F401
import numpy as np
import pytest
from texts import ODD, frame, odd, prose, rows

from broadsheet.llm import neardup as N
from broadsheet.llm import setsketch as K
from broadsheet.llm.words import SPACES, hash_texts
from broadsheet.operators.graphs import components


def brute(docs, size=4):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(seed, copies, words, changes):
    pick = random.Random(seed)
    base = prose(seed, words).split()
    out = [" ".join(base)]
    for k in range(copies):
        w = list(base)
        for _ in range(pick.randrange(changes + 1)):
            w[pick.randrange(len(w))] = f"new{k}x{pick.randrange(99)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, fruitful", [(2048, 0.01), (7, 2.0)])
def test_equals_brute_force(spark, monkeypatch, block, fruitful):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "FRUITFUL", fruitful)
    texts = [*ODD, *family(1, 40, 120, 8), *family(2, 10, 60, 2), *family(3, 12, 400, 30), prose(1, 120), *(prose(k, 50) for k in range(60, 90))]
    random.Random(4).shuffle(texts)
    docs = [(d * 10, t) for d, t in enumerate(texts)]
    got = N.digests(frame(spark, docs, "doc_id bigint, text string")).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(spark):
    texts = [*family(5, 9, 200, 1), prose(77, 200), None, ""]
    docs = frame(spark, rows(*texts) + [rows(*texts)[0], (None, prose(78, 30), None, None, None)])
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, 0), (False, 10), (False, 11), (False, 12), (True, None)])


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    a, near_a, b, near_b, alone = *family(5, 1, 200, 1), *family(6, 1, 200, 1), prose(91, 80)
    docs = [(1, near_a), (2, a), (2, b), (3, near_b), (4, alone), (4, alone), (None, alone), (None, alone), (5, None), (5, ""), (6, b), (6, near_b)]
    table = frame(spark, docs, "doc_id bigint, text string")
    # Every row is a document of its own; brute force numbers them.
    found = brute(list(enumerate(t if d is not None else None for d, t in docs)))
    least = {}
    for n, (d, _) in enumerate(docs):
        if d is not None:
            least[found[n][1]] = min(least.get(found[n][1], d), d)
    want = [(d, least.get(found[n][1]) if d is not None else None) for n, (d, _) in enumerate(docs)]
    key = lambda p: (p[0] is None, p[0] or 0, p[1] or 0)
    got = [(r.doc_id, r.component_id) for r in N.digests(table).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = [(r.doc_id, r.text) for r in N.deduplicated(table).collect()]
    assert sorted(kept, key=str) == sorted([(1, near_a), (2, b), (4, alone), (None, alone), (None, alone), (5, None), (5, "")], key=str)


def test_ids_may_be_texts(spark):
    texts = [*family(5, 3, 200, 1), prose(77, 200)]
    docs = frame(spark, [(f"d{n}", t) for n, t in enumerate(texts)], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in N.digests(docs).collect()} == {"d0": "d0", "d1": "d0", "d2": "d0", "d3": "d0", "d4": "d4"}


def test_odd_and_empty_tables(spark):
    docs = odd(spark)
    got = N.digests(docs).collect()
    assert len(got) == docs.count()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (0, 1, 2, 3))
    assert N.digests(docs.limit(0)).count() == 0


def test_sketches_estimate_and_bounds_hold():
    pick = np.random.default_rng(1)
    pool = pick.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = int(1000 * share / (2 - 2 * share) * 2)
        common, own = pool[:n], pool[n : n + 1000]
        sets = [np.unique(np.r_[common, own[:500]]), np.unique(np.r_[common, own[500:]])]
        both = len(np.intersect1d(*sets))
        true = both / (len(sets[0]) + len(sets[1]) - both)
        sketches = K.registers(sets)
        sizes = [np.array([float(len(s))]) for s in sets]
        scores = K.likelihoods(sketches[:1], sketches[1:], *sizes, K.GRID)
        assert abs(K.GRID[scores.argmax()] - true) < 0.15
        assert K.may_reach(sketches[:1], sketches[1:], *sizes, true)[0]
        apart = np.bitwise_count(K.parity(sets[0]) ^ K.parity(sets[1])).sum()
        assert apart <= len(sets[0]) + len(sets[1]) - 2 * both
    union = K.registers([np.union1d(*sets)])
    assert (union[0] == np.maximum(*K.registers(sets))).all()
    assert len(K.shingle_sets(*hash_texts(["a b", "a b c d e", ""], SPACES), 4)) == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 240)] + [(5, 5), (300, 299)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.label for r in components(frame(spark, edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 240)}, 299: 299, 300: 299}
