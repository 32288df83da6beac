"""The weekly review as an issue: what it reads, how it is ordered, and where it is kept."""

from __future__ import annotations

from datetime import datetime

from broadsheet.operators import responses
from broadsheet.plans.weekly import run_weekly
from broadsheet.schema import ISSUE
from broadsheet.sources import versions
from pyspark.sql import functions as F

END, NOW = "2024-03-20", "2024-03-20 08:00:00"
SECTIONS = [
    {"id": "tech", "section_pos": 1, "enabled": True},
    {"id": "news", "section_pos": 0, "enabled": True},
    {"id": "off", "section_pos": 2, "enabled": False},
]


def issue(date, slot, *items):
    """Items are (id, section, score, hour)."""
    row = dict.fromkeys(f.name for f in ISSUE.fields)
    fields = [f.name for f in ISSUE["items"].dataType.elementType.fields]
    whole = [
        {**dict.fromkeys(fields), "id": i, "title": f"Title {i} of {date}", "source": "s", "section": s, "rank_score": r, "published_at": datetime(2024, 3, int(date[-2:]), h), "summary": f"sum {i}"}
        for i, s, r, h in items
    ]
    row |= {"date": date, "slot": slot, "generated_at": datetime(2024, 1, 1), "items": whole, "item_count": len(whole), "warnings": []}
    return tuple(row[f.name] for f in ISSUE.fields)


def commit(spark, path, *rows):
    versions.commit_issues(spark.createDataFrame(list(rows), ISSUE), str(path))


def reviews(spark, path):
    found = versions.read_committed(spark, str(path)).where("slot = 'weekly'").collect()
    return {r.date: r for r in found}


def ids(record):
    return [i.id for i in record["items"]]


def test_window_sections_and_order(spark, tmp_path):
    commit(
        spark,
        tmp_path,
        issue(END, None, ("a", "tech", 0.9, 1), ("n", "news", 0.1, 1), ("o", "off", 9.0, 1), ("gone", "unknown", 9.0, 1)),
        issue("2024-03-14", None, ("b", "tech", 0.8, 1), ("tie-old", "tech", 0.5, 1), ("a", "tech", 5.0, 2)),
        issue("2024-03-18", "evening", ("tie-new", "tech", 0.5, 1)),
        issue("2024-03-13", None, ("outside", "tech", 9.0, 1)),
        issue("2024-03-18", "weekly", ("reprint", "tech", 9.0, 1)),
    )
    done = run_weekly(spark, str(tmp_path), END, NOW, SECTIONS)
    kept = reviews(spark, tmp_path)[END]
    # Sections by their places; the newest copy of an id counts, with its own score.
    assert ids(kept) == ["n", "a", "b", "tie-new", "tie-old"]
    assert [i.summary for i in kept["items"]][:2] == ["sum n", "sum a"] and kept["items"][1].rank_score == 0.9
    assert (kept.schedule_id, kept.lookback_hours, kept.item_count, kept.digest, kept.warnings) == ("weekly", 168.0, 5, None, [])
    assert tuple(done.window.first()) == ("2024-03-14", END, 3, 5)
    assert ids(done.record.first()) == ids(kept)


def test_limit_and_days(spark, tmp_path):
    commit(spark, tmp_path, issue(END, None, *((f"t{k}", "tech", float(k), 1) for k in range(9))), issue("2024-03-19", None, ("x", "tech", 99.0, 1)))
    run_weekly(spark, str(tmp_path), END, NOW, SECTIONS, days=1, limit=3)
    assert ids(reviews(spark, tmp_path)[END]) == ["t8", "t7", "t6"]


def test_a_second_run_replaces_the_review_alone(spark, tmp_path):
    commit(spark, tmp_path, issue(END, None, ("a", "tech", 1.0, 1)), issue("2024-03-13", "weekly", ("w", "tech", 1.0, 1)))
    run_weekly(spark, str(tmp_path), END, NOW, SECTIONS)
    commit(spark, tmp_path, issue("2024-03-19", None, ("b", "tech", 2.0, 1)))
    run_weekly(spark, str(tmp_path), END, NOW, SECTIONS)
    assert {d: ids(r) for d, r in reviews(spark, tmp_path).items()} == {END: ["b", "a"], "2024-03-13": ["w"]}
    assert versions.read_committed(spark, str(tmp_path)).where("slot IS NULL").count() == 2
    # The next week does not read this week's review.
    run_weekly(spark, str(tmp_path), "2024-03-26", NOW, SECTIONS)
    assert ids(reviews(spark, tmp_path)["2024-03-26"]) == ["a"]


def test_nothing_to_review(spark, tmp_path):
    assert run_weekly(spark, f"{tmp_path}/none", END, NOW, SECTIONS).record.count() == 0
    commit(spark, f"{tmp_path}/other", issue("2024-01-01", None, ("a", "tech", 1.0, 1)))
    done = run_weekly(spark, f"{tmp_path}/other", END, NOW, SECTIONS, digest=lambda e: e.select("run_id", F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.lit("x").alias("raw")))
    assert done.record.count() == 0 and not reviews(spark, f"{tmp_path}/other")
    assert tuple(done.window.first()) == ("2024-03-14", END, 0, 0)


def answered(raw, error=None):
    def answer(entries):
        rows = entries.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("entry", "title", "body"))).alias("e"))
        said = F.lit(raw) if raw is not None else F.concat_ws("|", F.transform("e", lambda x: F.concat_ws("=", x["title"], x["body"])))
        return rows.select("run_id", F.lit("m").alias("model"), F.lit("7").alias("prompt_version"), said.cast("string").alias("raw"), F.lit(error).cast("string").alias("error"))

    return answer


def test_the_digest_or_its_failure(spark, tmp_path):
    commit(spark, tmp_path, issue(END, None, ("a", "tech", 1.0, 1), ("n", "news", 0.5, 1)))
    text = f"Title n of {END}=sum n|Title a of {END}=sum a"
    for answer, digest, warnings in (
        (answered(None), text, []),
        (answered('{"digest": "  What matters. "}'), "What matters.", []),
        (answered(""), None, [responses.DIGEST_WARNING + responses.NO_DIGEST]),
        (answered('{"digest": 5}'), None, [responses.DIGEST_WARNING + responses.NO_DIGEST]),
        (answered("late", "HTTP 500"), None, [responses.DIGEST_WARNING + "HTTP 500"]),
        (lambda e: answered("x")(e).limit(0), None, [responses.DIGEST_WARNING + responses.NO_DIGEST]),
    ):
        run_weekly(spark, str(tmp_path), END, NOW, SECTIONS, digest=answer)
        kept = reviews(spark, tmp_path)[END]
        assert (kept.digest and kept.digest.text, kept.warnings) == (digest, warnings)
        assert kept.digest is None or tuple(kept.digest.meta) == ("llm", "m", "7", "summaries")
        assert ids(kept) == ["n", "a"]


def test_missing_summaries_are_counted_by_reason(spark):
    tasks = spark.createDataFrame([("r", f"i{k}", 0, k) for k in range(6)], "run_id STRING, id STRING, section_pos INT, rank_in_section INT")
    said = [("r", "i0", "fine", None), ("r", "i1", "", None), ("r", "i2", None, "HTTP 429"), ("r", "i3", None, "HTTP 429"), ("r", "i4", "{}", None)]
    answers = spark.createDataFrame(said, "run_id STRING, item_id STRING, raw STRING, error STRING")
    found = responses.summary_failures(tasks, answers, responses.parse_responses(answers, 100)).collect()
    assert sorted((r.pos.rank_in_section, r.message) for r in found) == [(1, responses.NO_SUMMARY), (2, "HTTP 429"), (3, "HTTP 429"), (4, responses.NO_SUMMARY), (5, responses.NO_SUMMARY)]
