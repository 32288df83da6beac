import random

import llm_paths  # noqa: F401
import numpy as np
from pyspark.sql import functions as F
from texts import SCHEMA, frame, odd

from broadsheet.llm import language as L

PARTS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["ção", "nh", "lh", "ão"]}


def text(pick, name, words):
    return " ".join("".join(pick.choice(PARTS[name]) for _ in range(pick.randrange(1, 4))) for _ in range(words))


def corpus():
    pick = random.Random(1)
    out = []
    for i in range(300):
        name = pick.choice(list(PARTS))
        out.append((i, text(pick, name, pick.randrange(3, 60)), name, f"www.host{i % 5}.{name}", 0))
    return out


def test_texts_and_priors_tell_the_language(spark):
    docs = frame(spark, corpus())
    model = L.fitted(docs.filter("doc_id % 2 = 0"))
    assert model.languages == ["aa", "bb", "cc"]
    got = L.identified(docs, model, None, F.col("source")).collect()
    assert len(got) == 300
    assert np.mean([r.language == r.lang for r in got]) > 0.99 and not any(r.rejected for r in got)
    # A text that two languages share follows its host, and its declaration before that.
    extra = docs.union(frame(spark, [(900, "x", None, "www.host1.bb", 0), (901, "x", "cc", "www.new.bb", 0), (902, "7 --", "aa", "www.host1.bb", 0)]))
    found = {r.doc_id: r for r in L.identified(extra.withColumn("text", F.when(F.col("doc_id") == 900, "zz zz").when(F.col("doc_id") == 901, "zz zz").otherwise(F.col("text"))), model, F.when(F.col("doc_id") >= 900, F.col("lang")), F.col("source")).collect()}
    assert found[900].language == "bb" and found[901].language == "cc" and found[902].rejected


def test_scores_equal_plain_counting(spark):
    texts = ["kalomi tu", "Schung-eit 42", "", None, "a"]
    counts = np.arange(3 * L.FEATURES).reshape(3, -1) % 97 + 1.0
    model = L.TextModel(["aa", "bb", "cc"], counts)
    import pyarrow as pa

    column = pa.array(texts)
    scores, number = model.score(column)
    for i in range(len(texts)):
        want, n = np.zeros(3), 0
        for row, place in L._runs(pa.array([texts[i]])):
            want, n = want + model.chances[:, place].sum(axis=1), n + len(place)
        assert np.allclose(scores[i], want / max(1, n / L.WEIGHT)) and number[i] == n
    assert number.tolist()[2:] == [0, 0, 0]


def test_markup_gives_text_and_declaration(spark):
    pages = [(1, '<html LANG="de-AT"><script>let a;</script><p>F&uuml;r&nbsp;dich &amp; &#x4e2d; &lt;b&gt;</p><!-- no --></html>'), (2, None), (3, "plain")]
    got = {r.page_id: (r.declared, r.text and r.text.split()) for r in L.markup_text(frame(spark, pages, "page_id bigint, html string")).collect()}
    assert got[1] == ("de", ["Für", "dich", "&", "中", "<b>"]) and got[2][0] is None and got[3] == (None, ["plain"])


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    model = L.fitted(docs)
    got = L.identified(docs.withColumnRenamed("n_chars", "chance"), model, F.col("lang"), F.col("source")).collect()
    assert len(got) == docs.count() and all(r.rejected for r in got if r.doc_id in (0, 1, 2, 3))
    assert L.identified(docs.limit(0), model, F.col("lang"), None).count() == 0
    nothing = L.fitted(frame(spark, [], SCHEMA))
    assert all(r.rejected for r in L.identified(docs, nothing, F.col("lang"), F.col("source")).collect())


def test_texts_of_no_known_language_are_rejected(spark):
    pick = random.Random(3)
    docs = frame(spark, corpus())
    model = L.fitted(docs)
    garbled = "".join(pick.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300))
    texts = ["这是一个没有模型的语言的文本", "هذا نص بلغة أخرى غير معروفة", garbled, text(pick, "aa", 30), text(pick, "aa", 2)]
    rows_ = frame(spark, [(i, t, "aa", "www.host1.aa", 0) for i, t in enumerate(texts)])
    for declared in (None, F.col("lang")):
        got = {r.doc_id: r.rejected for r in L.identified(rows_, model, declared, F.col("source")).collect()}
        assert [got[i] for i in range(5)] == [True, True, True, False, False]


def fused(rows_, model, right):
    """The fusion of (id, text, declared, host), read plainly: (id, language, chance) by id."""
    import pyarrow as pa

    names, k = model.languages, len(model.languages)
    scores, number = model.score(pa.array([r[1] for r in rows_], pa.string()))
    normal = lambda v: v / v.sum()
    own, hosts, suffixes, top = [], {}, {}, np.zeros(k)
    for (_, _, declared, host), score, n in zip(rows_, scores, number):
        stated = np.zeros(k)
        if declared in names:
            stated = np.array([np.log(right if name == declared else (1 - right) / (k - 1)) for name in names])
        own.append(score + stated)
        if n:
            chance = normal(np.exp(own[-1] - own[-1].max()))
            for table, key in ((hosts, host or ""), (suffixes, (host or "").split(".")[-1])):
                table[key] = table.get(key, 0) + chance
            top = top + chance
    top, out = normal(top + 1), []
    for (i, _, _, host), logs, n in zip(rows_, own, number):
        above = normal(suffixes.get((host or "").split(".")[-1], 0) + L.SMOOTH * top)
        prior = normal(hosts[host or ""] + L.SMOOTH * above) if (host or "") in hosts else top
        logs = logs + np.log(prior)
        final = normal(np.exp(logs - logs.max()))
        out.append((i, names[int(final.argmax())], round(float(final.max()), 6)))
    return sorted(out)


def plain_reliability(rows_, model):
    import pyarrow as pa

    scores, number = model.score(pa.array([r[1] for r in rows_], pa.string()))
    chances = []
    for (_, _, declared, _), score, n in zip(rows_, scores, number):
        if n and declared in model.languages:
            p = np.exp(score - score.max())
            chances.append(p[model.languages.index(declared)] / p.sum())
    right = 0.9
    for _ in range(500):
        hits = [right * p / (right * p + (1 - right) * (1 - p) / (len(model.languages) - 1)) for p in chances]
        right = min(0.999, (sum(hits) + 9) / (len(hits) + 10))
    return right


def noisy(share):
    """Short texts of three languages, a share of them declared wrongly; odd hosts and nulls."""
    pick, out = random.Random(7), []
    for i in range(400):
        name = pick.choice(list(PARTS))
        said = pick.choice([n for n in PARTS if n != name]) if pick.random() < share else name
        host = pick.choice([f"a.host{pick.randrange(4)}.{name}", "localhost", None, "", "x.com"])
        out.append((i, text(pick, name, pick.choice([0, 1, 2, 9])), pick.choice([said, said, said, None, "zz"]), host))
    return out + [(400, None, "aa", "b.unheard.xx"), (401, "12 34", None, None)]


def test_fusion_equals_a_plain_one(spark):
    model = L.fitted(frame(spark, corpus()))
    for share in (0.0, 0.3):
        rows_ = noisy(share)
        docs = frame(spark, rows_, "doc_id bigint, text string, said string, host string")
        right = plain_reliability(rows_, model)
        assert abs(right - (1 - share)) < 0.08
        for given in (0.8, None):
            found = L.identified(docs, model, F.col("said"), F.col("host"), right=given).collect()
            want = fused(rows_, model, given or right)
            got = sorted((r.doc_id, r.language, round(r.chance, 6)) for r in found)
            # Chances are put into bins, which hardly moves what is learned.
            near = 1e-5 if given else 2e-3
            assert [g[0] for g in got] == [w[0] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want)) < near
            heard = {r[0] for r in rows_ if r[1] and any(c.isalpha() for c in r[1])}
            assert all(g[1] == w[1] for g, w in zip(got, want) if g[0] in heard and g[2] > 0.51)


def test_rare_languages_are_learned(spark):
    pick = random.Random(11)
    docs = [(i, text(pick, "aa", 5), "aa", "h", 0) for i in range(600)] + [(600 + i, text(pick, "bb", 5), "bb", "h", 0) for i in range(3)]
    docs += [(700, None, "cc", "h", 0), (701, "7", "dd", "h", 0)]
    model = L.fitted(frame(spark, docs), bound=60)
    assert model.languages == ["aa", "bb", "dd"]
    runs = np.exp(model.chances)
    assert (runs[1] > runs[1].min() * 1.5).sum() > 5 and np.ptp(runs[2]) < 1e-12
