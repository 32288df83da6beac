import random
import re

import llm_paths  # noqa: F401
import numpy as np
import pytest
from texts import ODD, frame, odd, prose, rows

from broadsheet.llm import decontaminate as D
from broadsheet.llm.fmindex import FMIndex, WaveletTree, suffix_order


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(item) if item is not None else "")
    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    ids |= windows[tuple(w[p : p + size])]
        out.append((key, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def test_suffixes_ranks_and_places():
    pick = random.Random(1)
    for _ in range(40):
        parts = [[pick.randrange(1, 4) for _ in range(pick.randrange(1, 30))] for _ in range(4)]
        text = np.array([x for p in parts for x in (*p, 0)], np.int64)
        index = FMIndex(text, 3, every=4)
        needle = [pick.randrange(1, 4) for _ in range(pick.randrange(1, 5))]
        padded = np.zeros((1, 5), np.int64)
        padded[0, : len(needle)] = needle
        low, high = index.search(padded, np.array([len(needle)]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        want = [i for i in range(len(text)) if text[i : i + len(needle)].tolist() == needle]
        assert places == want
    symbols = np.array([pick.randrange(6) for _ in range(100)])
    tree = WaveletTree(symbols, 5)
    assert (tree.at(np.arange(100)) == symbols).all()
    assert tree.rank(np.array([3]), np.array([57]))[0] == (symbols[:57] == 3).sum()
    assert suffix_order(np.array([2, 1, 2, 1, 0])).tolist() == [4, 3, 1, 2, 0]


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    items = [(1, prose(50, 30)), (2, "short one here"), (3, None), (4, ""), (5, prose(50, 30)), (None, prose(51, 12)), (7, "…")]
    planted = [prose(9, 20) + " " + prose(50, 30) + " " + prose(10, 5), "Short, ONE: here!", prose(50, 30)[:90] + " x", prose(51, 12) * 2]
    data = [(d, t) for d, t, *_ in rows(*ODD, *planted, *(prose(k, 60) for k in range(100, 130)), prose(3, 5000))] + [(None, planted[0])]
    docs, known = frame(spark, data, "doc_id bigint, text string"), frame(spark, items, "item_id bigint, text string")
    found = D.contamination(docs, known).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found), key=repr)
    assert got == brute(data, items)
    for r in found:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_removal_cuts_the_passages_and_nothing_else(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    item = prose(50, 30)
    docs = frame(spark, [(1, f"Before it. {item}, after it."), (2, "clean text"), (3, None)], "doc_id bigint, text string")
    known = frame(spark, [(1, item)], "item_id bigint, text string")
    out = {r.doc_id: r.text for r in D.contamination(docs, known, cut=True).collect()}
    tail = item[len(item.rstrip(".")) :]
    assert out == {1: f"Before it. {tail}, after it.", 2: "clean text", 3: None}


def test_odd_and_empty_tables(spark):
    none = frame(spark, [], "item_id bigint, text string")
    docs = odd(spark)
    rows_ = D.digests(docs, none).collect()
    assert len(rows_) == docs.count() and not any(r.contaminated for r in rows_)
    clash = docs.withColumnRenamed("source", "spans").withColumnRenamed("lang", "items")
    assert D.contamination(clash, none).columns == ["doc_id", "text", "n_chars", "n_words", "spans", "items"]
    assert D.digests(docs.limit(0), none).count() == 0
