import hashlib
import random

import llm_paths  # noqa: F401
import public_tokenizers
import pytest
import sentencepiece
from texts import frame, odd, rows, SCHEMA

from broadsheet.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(PATH).coder()


def test_ids_and_texts_equal_the_library(coder, library):
    pick = random.Random(5)
    letters = list("aaab ▁ e\n\t<0x>0A1é日本語😀\x00²thinginteresti.,") + ["the ", "ation", "  ", "ing", "</s>", "<unk>"]
    for n in range(4000):
        text = "".join(pick.choice(letters) for _ in range(pick.randrange(30)))
        ids = coder.encode(text)
        assert ids == library.encode(text)
        assert coder.decode(ids) == library.decode(ids)
    for text in ["a" * 4000, " " * 300, "thatthethere" * 200]:
        assert coder.encode(text) == library.encode(text)


def test_any_ids_decode_as_in_the_library(coder, library):
    pick = random.Random(6)
    for _ in range(2000):
        ids = [pick.randrange(32000) if pick.random() < 0.5 else pick.randrange(300) for _ in range(6)]
        assert coder.decode(ids) == library.decode(ids)


def test_borders_hold_exactly_where_merging_keeps_them(coder):
    pick = random.Random(7)
    words = [w for w in coder.pieces.id if 1 < len(w) < 6]
    for _ in range(3000):
        a, b = pick.choice(words), pick.choice(words)
        assert coder.compatible((a, b)) == (coder.pieces._merged(a + b) == [a, b])


def test_odd_rows_and_clashing_columns(spark, library):
    docs = odd(spark)
    got = pieces.digests(docs, PATH).collect()
    assert len(got) == docs.count()
    texts = {(r.doc_id, hashlib.sha256(library.decode(library.encode(r.text or "")).encode()).hexdigest()): r.text for r in docs.collect()}
    for row in got:
        ids = library.encode(texts[row.doc_id, row.decoded_sha256] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    clash = docs.selectExpr("text", "doc_id as ids", "lang as decoded")
    assert pieces.coded(clash, PATH).columns == ["text", "ids", "decoded"]
    assert pieces.digests(frame(spark, [], SCHEMA), PATH).count() == 0
    assert pieces.digests(frame(spark, rows(None)), PATH).first().n_tokens == 0
