import hashlib
import json
import random

import llm_paths  # noqa: F401
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts import SCHEMA, frame, odd, prose, rows
from tokenizers import Tokenizer

from broadsheet.llm import alignment as A

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


class Plain:
    """Whole texts through both libraries, and every pair of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        letters = A.byte_letters()
        vocabulary = json.load(open(BYTES, encoding="utf-8"))["model"]["vocab"]
        self.spelled = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t != "<|endoftext|>"}

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def links(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.spelled.get, a)) != want or b"".join(map(self.piece, b)) != want:
            return None
        # The tokens that hold each byte, in order.
        owners = [[k for k, i in enumerate(ids) for _ in spell(i)] for ids, spell in ((a, self.spelled.get), (b, self.piece))]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*owners))]
        groups, taken = [], ([], [])
        for at, pair in enumerate(zip(*owners)):
            for side, ids, k in zip(taken, (a, b), pair):
                if not side or side[-1][0] != k:
                    side.append((k, ids[k]))
            if at + 1 == len(want) or all(o[at + 1] != o[at] for o in owners):
                groups.append("|".join(",".join(str(i) for _, i in side) for side in taken))
                taken = ([], [])
        return len(a), len(b), groups, links


def brute(texts):
    plain = Plain()
    found = [plain.links(t) for t in texts]
    counts = {}
    for f in found:
        for pair in f[3] if f else ():
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for f in found:
        if not f:
            out.append((0,) * 6 + ("",))
            continue
        n_a, n_b, groups, links = f
        tops = sum(counts[p] == best[p[1]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), tops, sum(counts[p] for p in links), ";".join(groups)))
    return out


def strange(seed):
    """Texts that put every kind of space, mark and letter next to each other."""
    pick = random.Random(seed)
    some = [" ", " ", "  ", "   ", "\n", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "\x00"]
    some += ["word", "a", "é", "don't", "'s", "'ll ", "l'été", "100", "3.14", "日本語", "ß", "é", "😀", "—", "...", "?!", "</s>", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "_", "x>y", "ﬁ", "­", "﻿", "Ω"]
    return ["".join(pick.choice(some) for _ in range(pick.randint(1, 25))) for _ in range(150)]


def got(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()}


@pytest.mark.parametrize("lane", [2, 64])
def test_equals_the_libraries(spark, lane, monkeypatch):
    monkeypatch.setattr(A, "LANE", lane)
    monkeypatch.setattr(A, "BUFFER", 500)
    texts = strange(1) + [None, "", " ", "\n", "▁", "a ▁ b", "a▁", prose(3, 400), prose(3, 400), "x" * 3000, "é" * 700, " lead", "trail ", "in  side"]
    want = brute(texts)
    docs = frame(spark, rows(*texts)).repartition(4)
    assert got(A.aligned(docs, BYTES, PIECES)) == dict(enumerate(want))
    assert sum(w[0] == 0 for w in want) >= 5


def test_documents_of_the_table(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    table = docs.collect()
    want = brute([r.text for r in table])
    found = {tuple(r) for r in A.query(spark, SMALL).select("doc_id", *A.NUMBERS, "groups_sha256").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert found == {(r.doc_id, *w[:6], digest(w[6])) for r, w in zip(table, want)}


def test_odd_rows(spark):
    docs = odd(spark).withColumnRenamed("lang", "groups").withColumnRenamed("n_chars", "n_a")
    out = A.aligned(docs, BYTES, PIECES)
    assert out.columns == ["doc_id", "source", *A.NUMBERS, "groups"]
    assert sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.collect()) == sorted(brute([r.text for r in docs.collect()]))
    assert A.aligned(frame(spark, [], SCHEMA), BYTES, PIECES).count() == 0


@pytest.mark.parametrize("lane", [0, 5, 64])
def test_intersection(lane, monkeypatch):
    monkeypatch.setattr(A, "LANE", lane)
    pick = random.Random(2)
    lists, at = [], 0
    for _ in range(300):
        end = pick.randint(1, 60)
        lists.append([sorted({at + end, *(at + x for x in pick.sample(range(1, end + 1), pick.randint(0, end - 1)))}) for _ in range(2)])
        at += end
    flat, starts = zip(*((np.concatenate(side), np.cumsum([0, *map(len, side)])) for side in zip(*lists)))
    a_flags, b_flags, x, y = A.intersect(flat[0], starts[0], flat[1], starts[1])
    common = set(flat[0].tolist()) & set(flat[1].tolist())
    assert [set(f[g].tolist()) for f, g in zip(flat, (a_flags, b_flags))] == [common, common]
    # All lists lie end to end, so each range begins where the one before it ends.
    spans = [list(zip([0, *f[:-1].tolist()], f.tolist())) for f in flat]
    want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if u < e and s < v]
    assert sorted(zip(x.tolist(), y.tolist())) == want
