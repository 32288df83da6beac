"""Indexes beside the archive's versions against the scans that they replace."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_versions import frame, issue

from broadsheet.operators import dedupe, gramindex, searchindex, views
from broadsheet.sources import sidetables, versions
from broadsheet.sources.archive import issue_items, read_window

TODAY = "2024-01-20"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()


def title(pick, most=6):
    words = [pick.choice(WORDS) for _ in range(pick.randrange(0, most))]
    return " ".join(words) + pick.choice(["", "", " 1", " 22", "!", " É"])


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Three commits; the second one replaces days of the first, one day lies outside."""
    path, pick = str(tmp_path_factory.mktemp("archive")), random.Random(4)
    days = [f"2024-01-{d:02}" for d in (3, 8, 12, 15, 18)]
    some = lambda: [title(pick) for _ in range(8)] + [None]
    versions.commit_issues(frame(spark, *(issue(d, None, *some()) for d in days), issue("2024-01-18", "weekly", *some())), path)
    assert len(gramindex.extend(spark, path)) == 1
    versions.commit_issues(frame(spark, issue("2024-01-15", None, *some()), issue("2024-01-18", "late", *some())), path)
    assert len(gramindex.extend(spark, path)) == 1 and gramindex.extend(spark, path) == []
    versions.commit_issues(frame(spark, issue("2024-01-19", None, *some())), path)
    return path


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_near_history_equals_the_whole_search(spark, archive, threshold):
    pick = random.Random(9)
    rows = [(i, f"i{i}", title(pick)) for i in range(60)]
    items = dedupe.with_title_facts(spark.createDataFrame(rows, "trust BIGINT, id STRING, title STRING"))
    window = issue_items(read_window(versions.read_committed(spark, archive), TODAY))
    want = dedupe.near_published(items, dedupe.history_facts(window), threshold)
    got = gramindex.near_published(items, archive, TODAY, threshold=threshold)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert threshold > 0.5 or got.count() > 0


def test_only_folders_of_looked_up_grams_are_read(spark, archive):
    items = spark.createDataFrame([(1, "a", "zulu whiskey xray"), (2, "b", "short")], "trust BIGINT, id STRING, title STRING")
    gramindex.extend(spark, archive)
    assert gramindex.near_published(dedupe.with_title_facts(items), archive, TODAY).count() == 0
    some = sidetables.read(spark, archive, gramindex.NAME, gramindex.SCHEMA, [3, 5])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "IN (3,5)" in plan


@pytest.mark.parametrize("phrase", ["bravo", "Alpha Bravo", "o c", " hotel ", "2024-01-1", "late", "é", "zz", "zzzz", "x", "", "golf! src", "22", "o é"])
def test_search_equals_the_scan(spark, archive, phrase):
    whole = versions.read_committed(spark, archive)
    key = lambda rows, *c: sorted(str([r[k] for k in c]) for r in rows.collect())
    got, want = searchindex.search_issues(spark, archive, phrase), views.search_issues(whole, phrase)
    assert key(got, "date", "slot", "items") == key(want, "date", "slot", "items")
    got, want = searchindex.search_items(spark, archive, phrase), views.search_items(whole, phrase)
    assert key(got, "date", "slot", "pos", "title") == key(want, "date", "slot", "pos", "title")


def test_expiry_takes_derived_rows_along(spark, tmp_path):
    path = str(tmp_path)
    for text in ("alpha bravo charlie", "delta echo foxtrot"):
        versions.commit_issues(frame(spark, issue("2024-01-19", None, text)), path)
        gramindex.extend(spark, path)
    assert len(list((tmp_path / gramindex.NAME).iterdir())) == 2
    assert versions.expire(spark, path, keep=1, grace_seconds=-60) == 1
    assert len(list((tmp_path / gramindex.NAME).iterdir())) == 1
    assert searchindex.search_items(spark, path, "echo").count() == 0  # sources are null: no text
    assert [r.date for r in searchindex.search_issues(spark, path, "2024-01").collect()] == ["2024-01-19"]


@pytest.mark.parametrize("block, letters", [(3, 1 << 20), (1 << 16, 50)])
def test_search_over_small_blocks_equals_the_scan(spark, tmp_path, monkeypatch, block, letters):
    monkeypatch.setattr(searchindex, "BLOCK", block)
    monkeypatch.setattr(searchindex, "LETTERS", letters)
    path, pick = str(tmp_path), random.Random(6)
    some = lambda: [title(pick, 20) + " 𝒳y𝒳" for _ in range(pick.randrange(1, 9))] + [None, ""]
    for days in (("05", "06", "07"), ("06", "08")):
        issues = frame(spark, *(issue(f"2024-01-{d}", s, *some()) for d in days for s in (None, "late")))
        named = F.transform("items", lambda i: i.withField("source", F.lit("Src")))
        versions.commit_issues(issues.withColumn("items", named), path)
    whole = versions.read_committed(spark, path)
    for phrase in ("bravo", "ha br", "src", "𝒳Y𝒳 s", "2024-01-06 late", "echo src"):
        key = lambda rows, *c: sorted(str([r[k] for k in c]) for r in rows.collect())
        got, want = searchindex.search_issues(spark, path, phrase), views.search_issues(whole, phrase)
        assert key(got, "date", "slot", "items") == key(want, "date", "slot", "items")
        got, want = searchindex.search_items(spark, path, phrase), views.search_items(whole, phrase)
        assert key(got, "date", "slot", "pos", "title") == key(want, "date", "slot", "pos", "title")
        assert want.count() or phrase not in ("bravo", "src")


def test_an_index_has_no_row_for_a_run_of_a_text(spark, tmp_path):
    path = str(tmp_path)
    issues = frame(spark, *(issue(f"2024-01-{d:02}", None, *[f"alpha bravo charlie {k:02}" for k in range(40)]) for d in range(1, 21)))
    versions.commit_issues(issues.withColumn("items", F.transform("items", lambda i: i.withField("source", F.lit("src")))), path)
    searchindex.extend(spark, path)
    # 800 items and 20 issues have about 25 runs each; before, each run of each was a row.
    derived = [p for p in tmp_path.iterdir() if p.name.startswith(("issue_", "item_")) and not p.name.endswith("-staged")]
    assert len(derived) == 2
    assert sum(spark.read.parquet(str(p)).count() for p in derived) < 3000
    assert searchindex.search_items(spark, path, "charlie 07 s").count() == 20
