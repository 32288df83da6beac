import random
import re
import unicodedata

import pandas as pd
import pytest

from broadsheet.operators import dedupe, neardup


def key(title):
    folded = unicodedata.normalize("NFKC", title.lower())
    return " ".join(re.sub(r"[^\w\s]|_", " ", folded).split())


def grams(title):
    joined = key(title).replace(" ", "")
    return {joined[i : i + 4] for i in range(len(joined) - 3)}


def near(a, b, threshold):
    ga, gb = grams(a), grams(b)
    if min(len(ga), len(gb)) < 8 or sorted(re.findall(r"\d+", a)) != sorted(re.findall(r"\d+", b)):
        return False
    return 2 * len(ga & gb) / (len(ga) + len(gb)) >= threshold


def one_by_one(items, history, threshold):
    """The rules item by item in trust order."""
    kept, out = [], {}
    for trust, id_, title in sorted(items):
        k = key(title)
        if any(id_ == h[0] or (k and k == key(h[1])) for h in history):
            out[trust] = "seen"
        elif any(id_ == x[1] or (k and k == key(x[2])) for x in kept):
            out[trust] = "within"
        elif threshold and any(near(title, h[1], threshold) for h in history):
            out[trust] = "seen"
        elif threshold and any(near(title, x[2], threshold) for x in kept):
            out[trust] = "within"
        else:
            kept.append((trust, id_, title))
            out[trust] = None
    return out


WORDS = "alpha bravo charlie delta echo foxtrot golf hotel".split()


@pytest.mark.parametrize("seed, threshold, budget", [(1, 0.5, None), (2, 0.2, 300), (3, 0, None)])
def test_labels_equal_the_sequential_rules(spark, monkeypatch, seed, threshold, budget):
    rnd = random.Random(seed)

    def title(most):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(0, most))]
        return " ".join(words) + rnd.choice(["", "", " 1", " 2", "!"])

    items = [(n, f"i{rnd.randrange(60)}", title(5)) for n in range(90)]
    history = [(f"i{rnd.randrange(90)}", title(4)) for _ in range(5)]
    if budget:
        whole = dedupe.survivors
        monkeypatch.setattr(dedupe, "survivors", lambda rows, t: whole(rows, t, work_budget=budget))
    df = spark.createDataFrame(items, "trust long, id string, title string")
    old = dedupe.history_facts(spark.createDataFrame(history, "id string, title string"))
    got = {r.trust: r.cause for r in dedupe.label_drops(df, old, threshold).collect()}
    assert got == one_by_one(items, history, threshold)


def test_a_dropped_item_blocks_nobody(spark):
    base = "the quick brown fox jumps over a lazy dog tonight"
    mid = base + " and runs far away"
    far = "and runs far away from every single hunter over there"
    assert near(base, mid, 0.5) and not near(base, far, 0.5)
    items = [(1, "a", base), (2, "b", mid), (3, "c", far)]
    df = spark.createDataFrame(items, "trust long, id string, title string")
    got = {r.trust: r.cause for r in dedupe.label_drops(df, None, 0.3).collect()}
    assert got == one_by_one(items, [], 0.3)


def test_blocks_of_a_frequent_gram_find_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "TOP_GRAMS", 6)
    rnd = random.Random(4)
    titles = sorted({" ".join(rnd.choice(WORDS) for _ in range(4)) for _ in range(40)})
    df = spark.createDataFrame([(i, t, key(t), "") for i, t in enumerate(titles)], "node long, t string, title_key string, numbers string")
    pairs = neardup.matching_pairs(neardup.title_nodes(df.drop("t")), None, 0.4)
    got = {(r.a_node, r.b_node) for r in pairs.collect()}
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if near(titles[i], titles[j], 0.4)}
    assert got == want and pairs.count() == len(want)


@pytest.mark.parametrize("threshold", [0.2, 0.5])
def test_only_matching_pairs_leave_a_unit_of_work(spark, monkeypatch, threshold):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "GRAMS", 60)
    rnd = random.Random(7)
    titles = sorted({" ".join(rnd.choice(WORDS + ["7", "𝒳é𝒳"]) for _ in range(4)) for _ in range(60)})
    rows = [(i, key(t), ",".join(sorted(w for w in t.split() if w.isdigit()))) for i, t in enumerate(titles)]
    one, two = (neardup.title_nodes(spark.createDataFrame(rows[k::2], "node long, title_key string, numbers string")) for k in (0, 1))
    both = neardup.title_nodes(spark.createDataFrame(rows, "node long, title_key string, numbers string"))
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if near(titles[i], titles[j], threshold)}
    alone, across = neardup.matching_pairs(both, None, threshold), neardup.matching_pairs(one, two, threshold)
    assert sorted((r.a_node, r.b_node) for r in alone.collect()) == sorted(want)
    assert sorted(tuple(sorted((r.a_node, r.b_node))) for r in across.collect()) == sorted(p for p in want if (p[0] + p[1]) % 2)
    # No row for a gram that two titles share: grams are not dealt out.
    assert "explode(slice" not in alone._jdf.queryExecution().toString()


def test_trust_follows_weight_then_declaration_then_position(spark):
    df = spark.createDataFrame([("x", "low", 0), ("y", "new", 0), ("z", "top", 1), ("w", "top", 0)], "id string, source string, item_pos long")
    sources = [{"name": "low", "weight": 0.5}, {"name": "top", "weight": 2.0}]
    rows = dedupe.with_trust_key(df, sources).orderBy("trust").collect()
    assert [r.id for r in rows] == ["w", "z", "y", "x"]


def test_undeclared_sources_and_bodies_keep_one_row_each(spark):
    rows = [(f"{s}{b}{p}", f"Title of {s} {b} {p}", s, b, p) for s in ("a", "b", "known") for b in (0, 1) for p in range(8)]
    df = spark.createDataFrame(rows, "id string, title string, source string, body_pos int, item_pos long")
    trusted = dedupe.with_trust_key(df, [{"name": "known", "weight": 2.0}])
    got = trusted.orderBy("trust").collect()
    assert len({r.trust for r in got}) == len(rows)
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (not i.startswith("known"), i))
    labelled = dedupe.label_drops(trusted, None, 0.0)
    assert labelled.count() == len(rows) and labelled.where("cause is not null").count() == 0


def test_untitled_items_do_not_meet(spark):
    df = spark.createDataFrame([(i, f"id{i}", "") for i in range(30)] + [(30, "id0", "")], "trust long, id string, title string")
    old = dedupe.history_facts(spark.createDataFrame([("id5", ""), ("x", "")], "id string, title string"))
    got = {r.trust: r.cause for r in dedupe.label_drops(df, old, 0.2).collect()}
    assert got == {i: {5: "seen", 30: "within"}.get(i) for i in range(31)}


@pytest.mark.parametrize("component", [200_000, 3])
def test_a_long_chain_equals_the_sequential_rule(spark, monkeypatch, component):
    monkeypatch.setattr(dedupe, "COMPONENT", component)
    size = 600 if component > 3 else 12
    # Each title shares enough letters with its successor alone.
    pick = random.Random(9)
    parts = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(size + 1)]
    items = [(k, f"id{k}", parts[k] + parts[k + 1]) for k in range(size)]
    df = spark.createDataFrame(items, "trust long, id string, title string")
    got = {r.trust: r.cause for r in dedupe.label_drops(df, None, 0.3).collect()}
    assert got == {k: "within" if k % 2 else None for k in range(size)}


def test_small_components_share_groups(spark, monkeypatch, tmp_path):
    walk, log = dedupe._walk, str(tmp_path / "walks")

    def counted(key, rows, edges):
        with open(log, "a") as f:
            f.write("walk\n")
        return walk(key, rows, edges)

    monkeypatch.setattr(dedupe, "_walk", counted)
    pick = random.Random(4)
    words = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(40)]
    items = [(2 * k + again, f"id{2 * k + again}", words[k] + " again" * again) for k in range(40) for again in (0, 1)]
    df = spark.createDataFrame(items, "trust long, id string, title string")
    got = {r.trust: r.cause for r in dedupe.label_drops(df, None, 0.3).collect()}
    assert got == {k: "within" if k % 2 else None for k in range(80)}
    # Before, each of the 40 pairs was a group of its own.
    assert len(open(log).readlines()) == 1


def test_components_of_a_group_are_walked_apart():
    rows = pd.DataFrame({"trust": [1, 2, 3, 4], "id": [None, None, None, "x"], "title_key": ["a", "b", "c", "d"], "numbers": "", "node": [1, 2, 3, 3]})
    rows = rows.assign(_component=[1, 1, 3, 3], _bin=0)
    edges = pd.DataFrame({"a_node": [], "b_node": [], "_component": [], "_bin": []})
    kept = dedupe._walk((0,), rows, edges)
    # A null id repeats in its own component alone; the last row has the node of the one before.
    assert kept["trust"].tolist() == [1, 3] and list(kept.columns) == ["trust", "id", "title_key", "numbers", "node"]


def test_only_titles_of_the_same_numbers_count_as_meetings(spark, monkeypatch):
    def measured(*_):
        raise AssertionError("the bound is low enough")

    monkeypatch.setattr(dedupe, "pair_work", measured)
    df = spark.createDataFrame([(k, f"id{k}", f"some longer title {k}") for k in range(60)], "trust long, id string, title string")
    facts = dedupe.with_title_facts(df)
    assert dedupe.survivors(facts, 0.2, work_budget=1000).count() == 60


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_only_titles_near_in_size_meet(spark, monkeypatch, tmp_path, threshold):
    matches, log = neardup._matches, str(tmp_path / "units")

    def counted(left, right, letters, *rest):
        lengths = sorted(map(len, letters))
        with open(log, "a") as f:
            f.write(f"{lengths[0]} {lengths[-1]}\n")
        return matches(left, right, letters, *rest)

    monkeypatch.setattr(neardup, "_matches", counted)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "GRAMS", 400)
    rnd = random.Random(3)
    some = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60)]
    words = lambda n: " ".join(rnd.sample(some, n))
    titles = [words(3) for _ in range(30)] + [words(40) for _ in range(30)]
    titles += [t[:-1] + "z" for t in titles[::4]]
    rows = [(i, t, "") for i, t in enumerate(titles)]
    nodes = neardup.title_nodes(spark.createDataFrame(rows, "node long, title_key string, numbers string"))
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if near(titles[i], titles[j], threshold)}
    assert sorted(map(tuple, neardup.matching_pairs(nodes, None, threshold).select("a_node", "b_node").collect())) == sorted(want) and want
    found = neardup.matching_pairs(nodes.where("node % 2 = 0"), nodes.where("node % 2 = 1"), threshold)
    assert {tuple(sorted((r.a_node, r.b_node))) for r in found.collect()} == {p for p in want if (p[0] + p[1]) % 2}
    # Of 15 and of 200 letters: before, blocks were dealt by hash and held both.
    units = [tuple(map(int, line.split())) for line in open(log)]
    assert any(low > 100 for low, _ in units) and (threshold < 0.5 or all(high < 100 for low, high in units if low < 100))


def test_titles_that_do_not_match_halve_no_range(spark, monkeypatch):
    compared, whole = [], dedupe.matching_pairs
    monkeypatch.setattr(dedupe, "matching_pairs", lambda *given: compared.append(1) or whole(*given))
    rnd = random.Random(8)
    words = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(18))
    rows = [(k, f"id{k}", f"daily {words()}") for k in range(60)]
    facts = dedupe.with_title_facts(spark.createDataFrame(rows, "trust long, id string, title string"))
    assert dedupe.survivors(facts, 0.5, work_budget=100).count() == 60
    # Before, the shared grams of "daily" were taken for work, and each half was compared with those before it.
    assert len(compared) == 1
