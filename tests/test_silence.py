"""Sources that stop, in several files and batches, against a table and by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from broadsheet.streaming import jobs
from broadsheet.streaming.silence import silent_batch, silent_stream

SCHEMA = "source STRING, published_at TIMESTAMP"
START = datetime(2024, 1, 1)
BUDGET, DELAY = timedelta(hours=6), timedelta(hours=1)


def landed():
    """Four days of items, in order of time: one source stops, one pauses, one is steady."""
    pick = random.Random(3)
    rows = [("steady", START + timedelta(minutes=30 * i)) for i in range(192)]
    rows += [("stops", START + timedelta(minutes=pick.randrange(60) + 60 * i)) for i in range(20)]
    rows += [("pauses", START + timedelta(hours=h)) for h in (0, 3, 8, 8, 20, 26, 33, 70, 90)]
    rows += [("once", START + timedelta(hours=50))] + [("busy", START + timedelta(seconds=i)) for i in range(500)]
    return sorted(rows, key=lambda r: r[1])


def plain(rows):
    """Every silence longer than the budget, up to an hour before the newest item."""
    reach = max(t for _, t in rows) - DELAY
    out = set()
    for source in {s for s, _ in rows}:
        times = sorted(t for s, t in rows if s == source)
        for t, following in zip(times, [*times[1:], reach]):
            if following - t > BUDGET:
                out.add((source, t, t + BUDGET))
    return out


def written(spark, rows, folder, parts):
    for i in range(parts):
        part = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, folder, tmp_path):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.append_to_table(silent_stream(source, BUDGET), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    rows = spark.read.schema("source STRING, latest TIMESTAMP, stale_at TIMESTAMP").parquet(f"{tmp_path}/out")
    return [tuple(r) for r in rows.collect()]


def test_several_batches_report_what_a_table_does(spark, tmp_path):
    rows = landed()
    written(spark, rows, f"{tmp_path}/in", 5)
    want = plain(rows)
    assert {s for s, _, _ in want} == {"stops", "pauses", "once", "busy"}
    batch = [tuple(r) for r in silent_batch(spark.createDataFrame(rows, SCHEMA), BUDGET).collect()]
    assert sorted(batch) == sorted(want)
    assert sorted(streamed(spark, f"{tmp_path}/in", tmp_path)) == sorted(want)


def test_a_source_is_reported_once_however_the_files_are_cut(spark, tmp_path):
    rows = landed()
    written(spark, rows, f"{tmp_path}/in", 1)
    assert sorted(streamed(spark, f"{tmp_path}/in", tmp_path)) == sorted(plain(rows))


def test_odd_rows(spark):
    rows = [(None, START), ("a", None), ("a", START), ("a", START), ("b", datetime(2300, 1, 1))]
    assert silent_batch(spark.createDataFrame(rows, SCHEMA), BUDGET).count() == 0
    assert silent_batch(spark.createDataFrame([], SCHEMA), BUDGET).count() == 0
