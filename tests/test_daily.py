"""The end-to-end run: bodies in, archive, warnings and metrics out."""

from conftest import SMALL

from __spark_entry__ import queries


def test_two_days_from_bodies_to_archive(spark):
    rows = queries()["daily_issue"](spark, SMALL).collect()
    items = [r for r in rows if r.kind == "item"]
    assert {r.date for r in items} == {"2024-01-30", "2024-01-31"}
    assert len({r.value for r in items}) == len(items)
    assert all((r.number == 1) == (r.name == "rss") for r in items)
    warned = {(r.date, r.value) for r in rows if r.kind == "warning"}
    assert {v for _, v in warned if "failed" in v} == {'source "src4" failed: HTTP 503', 'source "src7" failed: body could not be parsed'}
    metric = {(r.date, r.kind.split()[1], r.name): r.number for r in rows if r.kind.startswith("metric")}
    for day in ("2024-01-30", "2024-01-31"):
        assert metric[day, "fetch", "items"] == sum(metric[day, "dedupe", n] for n in ("within_run", "seen", "kept"))
        assert metric[day, "fetch", "failed"] == 2
    assert metric["2024-01-31", "dedupe", "seen"] >= sum(r.date == "2024-01-30" for r in items)


def test_window_scans_only_its_partitions(spark, tmp_path, capsys):
    from broadsheet.plans.catalog_archive import TODAY, issues
    from broadsheet.sources import archive

    archive.write_archive(issues(spark, SMALL), str(tmp_path / "a"))
    archive.read_window(archive.read_archive(spark, str(tmp_path / "a")), TODAY).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
