import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_paths import *  # noqa: F403

from broadsheet.llm import words as W

PATTERNS = {"SPACES": rb"[^\x20\x09-\x0D]+", "SYMBOLS": rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB é\n\t\x0b.,1-日\x00", max_size=40)), max_size=8))
def test_equal_words_and_only_those_have_equal_hashes(texts):
    for name, pattern in PATTERNS.items():
        hashes, rows = W.hash_texts(texts, getattr(W, name))
        found = [re.findall(pattern, (t or "").encode().lower()) for t in texts]
        assert [len(f) for f in found] == np.diff(rows).tolist()
        flat = [w for f in found for w in f]
        known = {}
        for word, value in zip(flat, hashes.tolist()):
            assert known.setdefault(word, value) == value
        assert len(set(known.values())) == len(known)


def test_slices_split_no_word(monkeypatch):
    pick = random.Random(3)
    texts = ["".join(pick.choice("abc  \n") for _ in range(pick.randrange(60))) for _ in range(200)] + ["x" * 900]
    whole = W.hash_texts(texts, W.SPACES)
    monkeypatch.setattr(W, "SLICE", 16)
    for a, b in zip(whole, W.hash_texts(texts, W.SPACES)):
        assert (a == b).all()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(W.sliced([batch], "t", 50))
    assert [v for p in parts for v in p.column(0).to_pylist()] == texts and len(parts) > 20
    again = np.concatenate([W.word_hashes(p.column(0), W.SPACES)[0] for p in parts])
    assert (again == whole[0]).all()


def test_runs_differ_by_length_and_order():
    h, _ = W.hash_texts(["a b c a b c"], W.SPACES)
    three = W.runs(h, 3)
    assert three[0] == three[3] and len(set(three.tolist())) == 3
    assert len(W.runs(h[:2], 3)) == 0
