import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import filters, ranking
from broadsheet.operators.topk import top_k

NOW = dt.datetime(2024, 1, 31)


def items(spark, rows):
    df = spark.createDataFrame(rows, "id string, source string, score double, hours double, title string")
    return df.withColumns({
        "now": F.lit(NOW), "lookback_hours": F.lit(24), "excerpt": F.lit(None).cast("string"), "run_id": F.lit("r"),
        "published_at": F.timestamp_seconds(F.unix_seconds(F.lit(NOW)) - F.col("hours") * 3600),
    })


@pytest.mark.parametrize("heavy", [False, True])
def test_mid_rank_equals_counting(spark, heavy):
    rnd = random.Random(7)
    scores = [None if rnd.random() < 0.1 else float(0 if heavy and rnd.random() < 0.5 else rnd.randrange(30)) for _ in range(400)]
    rows = [(str(i), "ab"[i % 3 == 0], s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "id string, k string, score double")
    for r in ranking.mid_rank(df, ["k"], cuts=16).collect():
        same = [s for _, k, s in rows if k == r.k and s is not None]
        want = 0.5 if r.score is None else (sum(s < r.score for s in same) + sum(s == r.score for s in same) / 2) / len(same)
        assert r.percentile == want


def test_recency_is_clamped(evaluate):
    now = F.lit(NOW)
    at = [NOW, NOW - dt.timedelta(hours=6), NOW - dt.timedelta(hours=48), NOW + dt.timedelta(hours=1)]
    assert evaluate(lambda c: ranking.recency(c, now, F.lit(24.0)), at, "timestamp") == [1.0, 0.75, 0.0, 1.0]
    assert evaluate(lambda c: ranking.recency(c, now, F.lit(0.0)), at, "timestamp") == [0.0] * 4


def seats(rows, limit, minimum):
    """Deal seats round by round."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    by = {}
    for r in order:
        by.setdefault(r[1], []).append(r)
    chosen = []
    for n in range(minimum):
        for source in by:
            if n < len(by[source]) and len(chosen) < limit:
                chosen.append(by[source][n])
    for r in order:
        if len(chosen) < limit and r not in chosen:
            chosen.append(r)
    return [r[0] for r in sorted(chosen, key=lambda r: (-r[2], r[0]))]


@pytest.mark.parametrize("limit, minimum", [(5, 0), (5, 1), (4, 2), (7, 3), (50, 1), (1, 1)])
def test_line_up_equals_dealing(spark, limit, minimum):
    rnd = random.Random(limit * 10 + minimum)
    rows = [(f"i{n:02}", rnd.choice("aaabcd"), rnd.randrange(6) / 10) for n in range(30)]
    df = spark.createDataFrame(rows, "id string, source string, rank_score double").withColumns(
        {"run_id": F.lit("r"), "section": F.lit("s"), "published_at": F.lit(NOW), "limit": F.lit(limit), "min_per_source": F.lit(minimum)}
    )
    got = ranking.quota_lineup(df, ["run_id", "section"]).orderBy("rank_in_section").collect()
    assert [r.id for r in got] == seats(rows, limit, minimum)


def section(id_, pos, sources, limit=2, **more):
    return {"id": id_, "section_pos": pos, "title": id_, "sources": sources, "limit": limit, "min_per_source": 0, "include": [], "exclude": [], "enabled": True, **more}


def test_sections_do_not_share_an_item(spark):
    df = items(spark, [(f"i{n}", "s", float(n), 1.0, "t") for n in range(6)])
    out = ranking.exclusive_lineups(df, [section("one", 0, ["s"]), section("two", 1, ["s"], 3)], [])
    got = {r.section: [] for r in out.collect()}
    for r in out.orderBy("section", "rank_in_section").collect():
        got[r.section].append(r.id)
    assert got == {"one": ["i5", "i4"], "two": ["i3", "i2", "i1"]}


def test_waves_follow_shared_sources():
    waves = ranking.section_waves([section("a", 0, ["x"]), section("b", 1, ["y"]), section("c", 2, ["x", "y"]), section("d", 3, ["z"])])
    assert [[s["id"] for s in w] for w in waves] == [["a", "b", "d"], ["c"]]


def test_filter_edges(spark):
    rows = [
        ("edge", "s", 5.0, 24.0, "t"), ("late", "s", 5.0, 24.01, "t"), ("future", "s", 5.0, -0.01, "t"),
        ("low", "s", 4.9, 1.0, "t"), ("none", "s", None, 1.0, "t"), ("out", "s", 9.0, 1.0, "a.b BAD"), ("other", "q", 9.0, 1.0, "t"),
    ]
    facts = filters.source_facts(spark, [{"name": "s", "weight": 1.0, "min_score": 5.0}])
    got = filters.section_candidates(items(spark, rows), [section("x", 0, ["s"], exclude=["bad"])], facts)
    assert {r.id for r in got.collect()} == {"edge"}
    included = filters.section_candidates(items(spark, rows), [section("x", 0, ["s"], include=["A.B"])], facts)
    assert {r.id for r in included.collect()} == {"out"}


def test_resolve_lists():
    assert filters.resolve(["*"], ["a", "b"]) == ["a", "b"]
    assert filters.resolve(["b", "a"], ["a", "b", "c"], ["c", "a"]) == ["a"]
    assert filters.resolve(["*"], ["a", "b"], ["b"]) == ["b"]
    assert filters.needed_sources([section("a", 0, ["x"]), section("b", 1, ["y"], enabled=False)]) == ["x"]


def test_top_k_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("v"))
    want = None
    for n in (1, 7, 40):
        rows = top_k(df.repartition(n), ["g"], [F.desc("v"), F.asc("id")], 5).orderBy("g", "rank").collect()
        want = want or rows
        assert rows == want and len(rows) == 15
