"""Commits of the archive: whole, in any order, and after broken ones."""

from __future__ import annotations

from datetime import datetime

import pytest

from broadsheet.schema import ISSUE
from broadsheet.sources import versions
from pyspark.sql import functions as F


def issue(date, slot, *titles):
    row = dict.fromkeys(f.name for f in ISSUE.fields)
    fields = [f.name for f in ISSUE["items"].dataType.elementType.fields]
    items = [{**dict.fromkeys(fields), "id": t, "title": t} for t in titles]
    row |= {"date": date, "slot": slot, "generated_at": datetime(2024, 1, 1), "items": items, "item_count": len(items), "warnings": []}
    return tuple(row[f.name] for f in ISSUE.fields)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ISSUE)


def titles(spark, path, number=None):
    rows = versions.read_committed(spark, path, number).collect()
    return {(r.date, r.slot): [i.title for i in r["items"]] for r in rows}


def test_a_commit_replaces_its_own_issues_only(spark, tmp_path):
    path = str(tmp_path)
    assert titles(spark, path) == {}
    first = versions.commit_issues(frame(spark, issue("2024-01-01", None, "a"), issue("2024-01-01", "weekly", "w"), issue("2024-02-02", None, "b"), issue("2024-02-03", None)), path)
    second = versions.commit_issues(frame(spark, issue("2024-01-01", None, "A", "B")), path)
    assert (first, second) == (1, 2)
    assert titles(spark, path) == {("2024-01-01", None): ["A", "B"], ("2024-01-01", "weekly"): ["w"], ("2024-02-02", None): ["b"]}
    assert titles(spark, path, 1)["2024-01-01", None] == ["a"]
    gone = spark.createDataFrame([("2024-02-02", None)], "date STRING, slot STRING")
    versions.commit_issues(frame(spark), path, remove=gone)
    assert set(titles(spark, path)) == {("2024-01-01", None), ("2024-01-01", "weekly")}


def test_a_commit_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    versions.commit_issues(frame(spark, issue("2024-01-01", None, "a"), issue("2024-01-02", None, "b")), path)
    fails = F.udf(lambda t: 1 / 0 if t == "bad" else t)
    broken = frame(spark, issue("2024-01-01", None, "new"), issue("2024-01-02", None, "bad")).withColumn("config_hash", fails(F.col("items")[0]["title"]))
    with pytest.raises(Exception):
        versions.commit_issues(broken, path)
    want = {("2024-01-01", None): ["a"], ("2024-01-02", None): ["b"]}
    assert titles(spark, path) == want

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_publish", lost)
        with pytest.raises(RuntimeError):
            versions.commit_issues(frame(spark, issue("2024-01-01", None, "new")), path)
    assert titles(spark, path) == want
    assert versions.expire(spark, path, keep=1, grace_seconds=-60) >= 1
    assert titles(spark, path) == want


def test_a_slower_commit_starts_again(spark, tmp_path, monkeypatch):
    path, publish = str(tmp_path), versions._publish
    versions.commit_issues(frame(spark, issue("2024-01-01", None, "a")), path)
    raced = []

    def behind(spark_, staged, target):
        if not raced:
            raced.append(True)
            versions.commit_issues(frame(spark, issue("2024-01-02", None, "other")), path)
        return publish(spark_, staged, target)

    monkeypatch.setattr(versions, "_publish", behind)
    assert versions.commit_issues(frame(spark, issue("2024-01-01", None, "mine")), path) == 3
    assert titles(spark, path) == {("2024-01-01", None): ["mine"], ("2024-01-02", None): ["other"]}


def test_expiry_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path)
    for text in ("a", "b", "c"):
        versions.commit_issues(frame(spark, issue("2024-01-01", None, text)), path)
    assert versions.expire(spark, path, keep=1) == 0  # within the grace
    assert versions.expire(spark, path, keep=2, grace_seconds=-60) == 1
    assert titles(spark, path, 2) == {("2024-01-01", None): ["b"]}
    assert titles(spark, path) == {("2024-01-01", None): ["c"]}
    with pytest.raises(ValueError):
        versions.expire(spark, path, keep=0)


def test_text_is_redacted_and_folders_are_pruned(spark, tmp_path, capsys):
    path = str(tmp_path)
    versions.commit_issues(frame(spark, issue("2024-01-01", None, "key hunter2hunter2 here"), issue("2024-02-01", None, "x")), path, ["hunter2hunter2"])
    assert "hunter2" not in str(titles(spark, path))
    versions.read_committed(spark, path).where("month = '02'").explain()
    assert "PartitionFilters" in (plan := capsys.readouterr().out) and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_issues_of_a_date_share_files(spark, tmp_path):
    path = str(tmp_path)
    rows = [issue(f"2024-01-0{d}", slot, f"{d} {slot}") for d in (1, 2) for slot in [None, "", *(f"c{i}" for i in range(60))] if slot != "" or d == 2]
    versions.commit_issues(frame(spark, *(r for r in rows if r[1] is not None or r[0] == "2024-01-01")), path)
    files = list(tmp_path.glob("data/**/*.parquet"))
    assert len(files) <= 10 and not list(tmp_path.glob("data/**/slot=*"))
    found = titles(spark, path)
    assert len(found) == 122 and found["2024-01-02", None] == ["2 "] and found["2024-01-01", "c7"] == ["1 c7"]
