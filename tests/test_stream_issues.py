"""Issues from several files and batches equal those of a plain loop over days."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from broadsheet.plans import catalog_versions
from broadsheet.sources import tables
from broadsheet.sources.archive import issue_items
from broadsheet.sources.versions import read_committed
from broadsheet.streaming import issues

SCHEMA = "id STRING, title STRING, url STRING, source STRING, published_at TIMESTAMP, score DOUBLE, excerpt STRING, item_pos BIGINT"
START = datetime(2024, 3, 1)
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()
SOURCES = [{"name": n, "source_pos": i, "weight": 1.0 + i / 10} for i, n in enumerate("ab")]
SECTIONS = [{"id": "one", "section_pos": 0, "title": "One", "sources": ["a", "b"], "limit": 6, "min_per_source": 1, "include": [], "exclude": [], "enabled": True}]
PLAN = issues.Plan(SECTIONS, SOURCES)


def rows():
    """Three days; titles come back, exactly and nearly, on later days."""
    pick = random.Random(8)
    out = []
    for i in range(45):
        title = " ".join(pick.choice(WORDS) for _ in range(4)) if i < 20 or pick.random() < 0.4 else out[pick.randrange(15)][1] + pick.choice(["", " again"])
        out.append((f"id{i}", title, f"https://x.test/{i}", pick.choice("ab"), START + timedelta(hours=1.6 * i), float(pick.randrange(100)), None, i))
    return out


def archived(spark, path):
    found = issue_items(read_committed(spark, path)).orderBy("date", "pos").collect()
    return [(r.date, r.pos, r.id) for r in found]


@pytest.fixture(scope="module")
def want(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plain"))
    dates = issues.build_dates(spark.createDataFrame(rows(), SCHEMA), PLAN, path)
    assert dates == ["2024-03-01", "2024-03-02", "2024-03-03"]
    return archived(spark, path)


def test_history_matters(want):
    ids = [r[2] for r in want]
    assert len(ids) == len(set(ids)) and {r[0] for r in want} == {"2024-03-01", "2024-03-02", "2024-03-03"}


@pytest.mark.parametrize("cuts", [[0, 45], [0, 20, 45]])
def test_batches_give_the_archive_of_one_batch(spark, want, tmp_path, cuts):
    data = rows()
    if len(cuts) > 2:  # late items of the first days, and items that are sent again
        data = data[10:] + data[:10]
        data = data[: cuts[1]] + data[:5] + data[cuts[1] :]
        cuts = [0, cuts[1], len(data)]
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(data[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    odd = [(None, "t", "u", "a", START, 1.0, None, 1), ("x", "t", "u", "a", None, 1.0, None, 1), ("y", "t", "u", "a", datetime(2300, 1, 1), 1.0, None, 1)]
    spark.createDataFrame(odd, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    paths = issues.Paths(f"{tmp_path}/out")
    issues.stream_issues(stream, PLAN, paths).awaitTermination()
    assert archived(spark, paths.archive) == want


def test_parts_land_in_as_many_files_as_tasks(spark, tmp_path):
    rows = [(i, START + timedelta(hours=i), i, "click", 1.0, "{}") for i in range(24 * 30)]
    schema = tables.COLUMNS["events"]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = []
    for raw in catalog_versions._landed(spark, str(tmp_path), f"{tmp_path}/in", 2):
        assert raw.isStreaming
        landed = spark.read.schema(schema).parquet(f"{tmp_path}/in")
        found.append((landed.count(), len(list((tmp_path / "in").glob("*.parquet")))))
    tasks = tables.table(spark, str(tmp_path), "events").rdd.getNumPartitions()
    assert tasks > 1 and found == [(15 * 24, tasks), (30 * 24, 2 * tasks)]
