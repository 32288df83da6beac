"""A landing folder in batch and as a stream, and arrival limits."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from broadsheet.operators.normalize import first_per_source
from broadsheet.sources import landing as L
from broadsheet.sources.feeds import parse_feeds
from broadsheet.streaming.jobs import append_to_table

AT = datetime(2024, 2, 1, 7, 0, 5, tzinfo=timezone.utc)
SCHEMA = "run_id string, source string, fetched_at timestamp, status int, body binary, body_pos int"


def feed(title, filler=""):
    return f"<rss version='2.0'><channel><item><title>{title}</title><link>https://e.com/1</link><description>{filler}</description></item></channel></rss>".encode()


FIRST = [
    ("a=1/é", "_s/ *%", AT, 200, feed("plain"), 0),
    ("a=1/é", "_s/ *%", AT, 200, feed("second body"), 1),
    ("a=1/é", "gone", AT, 404, b"", 0),
    ("a=1/é", "empty", AT, 200, None, 0),
    ("b", "latin", AT, 200, feed("caf").replace(b"caf", b"caf\xe9"), 0),
]
LATER = [
    ("b", "cut", AT, 200, feed("cut")[:60], 0),
    ("b", "measured", AT, 200, feed("m", "x" * 400), 0),
    ("b", "wide", AT, 200, feed("w", "漢" * 250), 0),
    ("b", "refused", AT, 200, feed("r", "x" * 2000), 0),
    ("b", None, AT, 200, feed("nobody"), 0),
]
WANT = [
    ("a=1/é", "_s/ *%", 0, "plain", None),
    ("a=1/é", "_s/ *%", 1, "second body", None),
    ("a=1/é", "gone", None, None, "HTTP 404"),
    ("a=1/é", "empty", None, None, "body could not be parsed"),
    ("b", "latin", 0, "caf�", None),
    ("b", "cut", None, None, "body could not be parsed"),
    ("b", "measured", 0, "m", None),
    ("b", "wide", 0, "w", None),
    ("b", "refused", None, None, f"response too large: {len(LATER[3][4])} bytes > 1800"),
]


def parsed(bodies):
    items, errors = parse_feeds(bodies)
    none = lambda kind: F.lit(None).cast(kind)
    rows = items.select("run_id", "source", "body_pos", "title", none("string").alias("error"))
    return rows.unionAll(errors.select("run_id", "source", none("int"), none("string"), "error"))


def as_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_batch_and_stream_read_the_same_items(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for part in (FIRST, LATER):
        assert L.land(spark.createDataFrame(part, SCHEMA), folder) == sum(r[1] is not None for r in part)
        rows = parsed(L.stream_bodies(spark, folder, max_body=600, files_per_batch=3))
        append_to_table(rows, out, log).awaitTermination()
    (tmp_path / "in" / "r-b" / "notes.body").write_bytes(b"\nno body by its name")
    batch = as_rows(parsed(L.read_bodies(spark, folder, max_body=600)))
    assert batch == sorted(WANT, key=str)
    assert as_rows(spark.read.schema(rows.schema).parquet(out)) == batch
    one = as_rows(parsed(L.read_bodies(spark, folder, "a=1/é", max_body=600)))
    assert one == sorted([r for r in WANT if r[0] == "a=1/é"], key=str)
    times = L.read_bodies(spark, folder).select(F.unix_seconds("fetched_at")).distinct().collect()
    assert [r[0] for r in times] == [int(AT.timestamp())]


def test_bodies_above_the_cap_are_measured_or_refused_unread(spark, tmp_path):
    L.land(spark.createDataFrame(LATER, SCHEMA), str(tmp_path))
    bodies = L.read_bodies(spark, str(tmp_path), max_body=600)
    plan = bodies._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1801)" in plan and "GreaterThan(length,1801)" in plan
    assert [r.source for r in bodies.where("body IS NULL").collect()] == ["refused"]
    # Landing the same bodies again replaces the same files.
    L.land(spark.createDataFrame(LATER, SCHEMA), str(tmp_path))
    assert L.read_bodies(spark, str(tmp_path)).count() == 4


def test_a_source_without_limit_keeps_all_and_leaves_the_others_cut(spark):
    rows = [("r" if n % 2 else "q", s, n) for s in ("free", "two", "unknown") for n in range(200)]
    items = spark.createDataFrame(rows, "run_id string, source string, item_pos int").repartition(7)
    limits = spark.createDataFrame([("free", None), ("two", 2), ("none", None), ("zero", 0)], "source string, fetch_limit int")
    got = {(r.run_id, r.source, r.item_pos, r.arrival) for r in first_per_source(items, limits).collect()}
    assert got == {(run, s, n, n // 2 + 1) for run, s, n in rows if s == "free" or (s == "two" and n < 4)}
    assert first_per_source(items.limit(0), limits).count() == 0
