import random

import llm_paths  # noqa: F401
import numpy as np
import pyarrow as pa
from texts import SCHEMA, frame, odd, prose

from broadsheet.llm import toxicity as X


def corpus(n=1500):
    pick = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = pick.random() < 0.12
        words = prose(i, pick.randrange(30, 120)).split()
        for _ in range(1 + len(words) // 30 if bad else 0):
            words.insert(pick.randrange(len(words)), pick.choice(["frobnitz", "grumbolt", "zwackel"]))
        docs.append((i, " ".join(words)))
        if pick.random() < 0.5:
            labels.append((i, 1, int(bad)))
        docs[-1] += (bad,)
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    truth = {d: bad for d, _, bad in docs}
    frame_ = frame(spark, [(d, t) for d, t, _ in docs], "doc_id bigint, text string")
    got = X.digests(frame_, frame(spark, labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_features_are_the_distinct_runs():
    texts = ["abcdef abcdef", None, "ABCDE", "abcd", "é" * 5, "x"]
    rows, places = X.features(pa.array(texts))
    want = [len({(t or "").encode().lower()[i : i + 5] for i in range(len((t or "").encode()) - 4)}) for t in texts]
    assert np.bincount(rows, minlength=6).tolist() == want
    assert places[rows == 2][0] in places[rows == 0]


def test_non_negative_risk_ignores_what_is_common():
    pick = np.random.default_rng(3)
    noise = [np.unique(pick.integers(0, 5000, 40)).astype(np.int32) for _ in range(900)]
    positives = [np.unique(np.r_[x, 7777]).astype(np.int32) for x in noise[:200]]
    unlabelled = [np.unique(np.r_[x, 7777] if i < 70 else x).astype(np.int32) for i, x in enumerate(noise[200:])]
    weights, bias = X.train(positives, unlabelled, 0.1)
    assert weights[7777] + bias > 0 > bias and np.flatnonzero(weights).tolist() == [7777]
    assert X.train([], unlabelled, 0.1)[1] == -50.0


def test_odd_rows_and_empty_tables(spark):
    docs, none = odd(spark), frame(spark, [], "doc_id bigint, quality int, toxic int")
    got = X.digests(docs, none).collect()
    assert len(got) == docs.count() and not any(r.predicted for r in got)
    some = frame(spark, [(13, 1, 1), (13, 1, 1), (14, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert X.digests(docs, some).count() == docs.count()
    assert X.digests(frame(spark, [], SCHEMA), some).count() == 0


def test_rare_terms_and_prior_of_all_learnable_texts(spark):
    rare = {i: "zwackel" for i in range(0, 36, 3)}
    docs = [(i, f"{prose(i, 8)} {rare.get(i, 'frobnitz') if i < 3000 else ''} {prose(-i, 4)}") for i in range(7000)]
    docs += [(7000, prose(1, 8) + " zwackel " + prose(2, 4)), (7001, prose(3, 12))]
    # More than 2,000 positives, of which 12 have nothing but the rare term.
    rows = frame(spark, docs, "doc_id bigint, text string")
    positives = rows.filter("doc_id < 3000").select("doc_id")
    got = {r.doc_id: r.score for r in X.scored(rows, positives, rows.doc_id < 7000, 3 / 7).collect()}
    assert len(got) == len(docs) and got[7000] > 0.5 > got[7001]
    assert sum(got[i] > 0.5 for i in rare) == len(rare)


def test_spark_and_local_training_agree(spark):
    docs, _ = corpus(400)
    rows = frame(spark, [(t, bad) for _, t, bad in docs], "text string, _positive boolean").repartition(3)
    weights, _ = X.trained(rows, 0.12)
    lists = [[X.features(pa.array([t]))[1] for _, t, bad in docs if bad is side] for side in (True, False)]
    assert len(np.flatnonzero(weights)) and np.array_equal(weights != 0, X.train(*lists, 0.12)[0] != 0)


def test_features_over_slices_without_numpys_unique(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from broadsheet.llm import toxicity as X

    texts = ["", "abc", None, "the quick brown fox " * 5, "é" * 70, "ABCDE", "abcde abcde", "x" * 200]
    one = [sorted(X.features(pa.array([t], pa.string()))[1].tolist()) for t in texts]
    monkeypatch.setattr(X, "SLICE", 16)
    monkeypatch.setattr(np, "unique", None)
    row, place = X.features(pa.array(texts, pa.string()))
    assert [place[row == i].tolist() for i in range(len(texts))] == one
    wanted = np.zeros(X.FEATURES, bool)
    wanted[one[3][::2]] = True
    row, place = X.features(pa.array(texts, pa.string()), wanted)
    assert [place[row == i].tolist() for i in range(len(texts))] == [[p for p in o if wanted[p]] for o in one]
    assert one[5] and set(one[5]) <= set(one[6]) and not one[0] and not one[1] and not one[2]
