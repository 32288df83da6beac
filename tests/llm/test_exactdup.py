import hashlib
import random

import llm_paths  # noqa: F401
from texts import SCHEMA, frame, odd, prose, rows
from pyspark.sql import functions as F

from broadsheet.llm import exactdup as X

SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(data):
    """(doc_id, text) -> (keep_id, size, kept, digest) per row."""
    groups = {}
    for key, text in data:
        groups.setdefault((text or "").translate(SPACES), []).append((-len(text or ""), key is None, key or 0, key))
    out = []
    for key, text in data:
        norm = (text or "").translate(SPACES)
        best = min(groups[norm])
        mine = (-len(text or ""), key is None, key or 0, key)
        out.append((key, best[3], len(groups[norm]), mine == best, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def copies():
    """Groups of all sizes; copies differ in white space, one group holds a third of the rows."""
    pick = random.Random(7)
    base = [prose(i, 12) for i in range(40)] + ["", " ", " ", "é", "a\x0bb", "ab"]
    texts = [pick.choice(base) for _ in range(300)] + [base[0]] * 170
    texts = [t.replace(" ", pick.choice([" ", "  ", "\n", "\t \r"])) if pick.random() < 0.5 else t for t in texts] + [None, None]
    keys = pick.sample(range(-1000, 1000), len(texts))
    return list(zip(keys, texts))


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in df.collect()), key=key)


def test_equals_plain_grouping(spark):
    data = copies()
    docs = frame(spark, data, "doc_id bigint, text string").repartition(6)
    assert found(X.marked(docs)) == sorted(brute(data), key=key)


def test_texts_that_share_a_digest_stay_apart(spark):
    data = copies()
    docs = frame(spark, data, "doc_id bigint, text string").repartition(5)
    for weak in (lambda t: F.substring(t, 1, 1), lambda t: F.lit("same")):
        got = found(X.marked(docs, digest=weak))
        assert [r[:4] for r in got] == sorted((r[:4] for r in brute(data)), key=key)


def test_hot_groups_are_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 10)
    monkeypatch.setattr(X, "SALTS", 3)
    data = copies()
    docs = frame(spark, data, "doc_id bigint, text string").repartition(9)
    assert found(X.marked(docs)) == sorted(brute(data), key=key)
    weak = found(X.marked(docs, digest=lambda t: F.substring(t, 1, 2)))
    assert [r[:4] for r in weak] == sorted((r[:4] for r in brute(data)), key=key)


def test_odd_rows(spark):
    docs = odd(spark).withColumn("kept", F.lit("mine")).withColumn("_norm", F.lit("n")).withColumn("c0", F.lit(1))
    got = X.marked(docs)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(got) == sorted(brute(data), key=key)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "_norm", "c0", "keep_id", "group_size", "kept", "digest"]
    assert X.marked(frame(spark, [], SCHEMA)).count() == 0


def test_deduplicated_leaves_one_row_of_each_group(spark):
    docs = odd(spark).withColumn("kept", F.lit("mine"))
    out = X.deduplicated(docs)
    assert out.columns == docs.columns
    texts = [(r.text or "").translate(SPACES) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(SPACES) for r in docs.collect()})
    again = frame(spark, rows("a b", "ab", "a  b"))
    assert [r.doc_id for r in X.deduplicated(again).collect()] == [2]


def test_plan_has_no_python(spark, capsys):
    from conftest import SMALL

    X.query(spark, SMALL).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Arrow", "Pandas"))
