import hashlib
import random

import llm_paths  # noqa: F401
from pyspark.sql import functions as F
from texts import ODD, SCHEMA, frame, odd, prose, rows

from broadsheet.llm import multiset as M


def vectors(spark, texts):
    df = M.lanes(frame(spark, list(enumerate(texts)), "i int, text string"), "text", "vector")
    return [r.vector for r in df.orderBy("i").collect()]


def test_edited_texts_and_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 5)
    texts = [*ODD, *(prose(k, 40).replace(".", ".\n") for k in range(30)), "", ODD[4]]
    data = [(d * 7 - 50, t) for d, t in enumerate(texts)]
    random.Random(1).shuffle(data)
    got = {r.doc_id: r for r in M.digests(frame(spark, data, "doc_id bigint, text string")).collect()}
    ordered = sorted(((d, t or "") for d, t in data), reverse=True)
    assert len(got) == len(ordered)
    prints = {}
    for i, (d, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint
        assert prints.setdefault(edited, got[d].edited_fingerprint) == got[d].edited_fingerprint
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if text == after:
            assert got[d].near_next == 1


def test_order_does_not_count_and_parts_add_up(spark):
    a, b, c = "one. two\nthree", "four\nfive five", "three"
    whole, turned, first, second, part, short = vectors(spark, [f"{a}\n{b}", f"{b}\n\n{a}", a, b, c, "one. two"])
    assert whole == turned != first
    df = spark.createDataFrame([(whole, first, second, part)], "w array<bigint>, a array<bigint>, b array<bigint>, c array<bigint>")
    out = df.select(M.inserted(F.col("a"), F.col("b")), M.deleted(F.col("w"), F.col("b")), M.deleted(F.col("a"), F.col("c"))).first()
    assert out[0] == whole and out[1] == first and out[2] == short


def test_likeness_follows_the_shared_part(spark):
    lines = [prose(k, 8) for k in range(400)]
    texts = ["\n".join(lines[:200]), "\n".join(lines[50:250]), "\n".join(lines[100:300]), "\n".join(lines[200:])]
    v = vectors(spark, texts)
    df = spark.createDataFrame([(v[0], x) for x in v], "a array<bigint>, b array<bigint>")
    near = [r[0] for r in df.select(M.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == 1 and abs(near[1] - 0.75) < 0.15 and abs(near[2] - 0.5) < 0.25 and near[3] < 0.4


def test_odd_rows_and_single_documents(spark):
    docs = odd(spark)
    assert M.digests(docs).count() == docs.count()
    assert M.digests(frame(spark, [], SCHEMA)).count() == 0
    one = M.digests(frame(spark, rows("abcd"))).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
