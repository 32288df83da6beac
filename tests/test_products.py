import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import documents, extraction, planning, responses
from broadsheet.operators.planning import Budget, Gate
from broadsheet.sources import archive, feeds
from broadsheet.operators import views
from broadsheet.operators.normalize import normalize
from broadsheet.plans.issue import Run, build_issue


def test_budget_equals_the_walk(spark):
    rnd = random.Random(3)
    rows = [(f"r{n % 4}", n // 12, n % 12 // 4, "x" * rnd.choice([5, 40, 90, 200]), rnd.random() < 0.2) for n in range(160)]
    df = spark.createDataFrame(rows, "run_id string, rank_in_section int, section_pos int, excerpt string, fetch_full_text boolean")
    budget = Budget(max_items=6, max_chars_per_item=100, max_total_chars=300)
    got = {(r.run_id, r.rank_in_section, r.section_pos): r.decision for r in planning.allocate_budget(df, budget).collect()}
    want = {}
    for run in {r[0] for r in rows}:
        spent = taken = 0
        for r in sorted([r for r in rows if r[0] == run], key=lambda r: (r[1], r[2])):
            cost = 100 if r[4] else min(len(r[3]), 100)
            if taken >= 6:
                verdict = "capped_by_items"
            elif spent + cost > 300:
                verdict = "capped_by_chars"
            else:
                verdict, spent, taken = "task", spent + cost, taken + 1
            want[r[:3]] = verdict
    assert got == want


def test_policy_layers_keep_explicit_false(spark):
    df = spark.createDataFrame([("a", "s"), ("b", "s")], "source string, section string")
    policy = [{"scope": "section", "key": "s", "summarize": True, "max_chars": 50}, {"scope": "source", "key": "a", "summarize": False}]
    got = {r.source: (r.summarize, r.max_chars, r.style) for r in planning.with_policy(df, policy).collect()}
    assert got == {"a": (False, 50, "bullet"), "b": (True, 50, "bullet")}


def test_gate(spark):
    rows = [("a", 0, "short", False), ("b", 0, "long enough text", False), ("c", 0, "Comments here and more", False), ("d", 0, "long enough text", True), ("e", 5, "x", True), ("f", 0, "  ", False)]
    df = spark.createDataFrame(rows, "title string, rank_in_section int, excerpt string, fetch_full_text boolean").withColumn("summarize", F.lit(True))
    gate = Gate(top_per_section=3, excerpt_shorter_than=6, excerpt_matches=["^comments"])
    assert {r.title for r in planning.gated(df, gate).where("candidate").collect()} == {"a", "c", "d", "f"}


def test_article_regions_menus_and_chrome(evaluate):
    long = "Words of the story go on and on. " * 10
    pages = [
        f"<body><nav>menu</nav><article>short</article><article><p>{long}</p><p>a<br>second line</p></article></body>",
        f"<body><header><nav>x</nav></header><main><p>{long}</p></main></body>",
        "<body><p>Only a body &amp; text</p><ul><li><a href=1>Home</a> <a href=2>About</a></li></ul><!-- no --></body>",
        "<p>no body at <a href=x>all</a> in this page</p><script>var x;</script>",
    ]
    first, second, third, fourth = evaluate(extraction.html_to_text, pages)
    assert first == long.strip() + "\nsecond line"
    assert second == long.strip()
    assert third == "Only a body & text"
    assert fourth == "no body at all in this page"


def test_article_acceptance(spark):
    html = "<article>" + "text " * 100 + "</article>"
    rows = [("https://n.test/", 200, "text/html; charset=x", html), ("https://n.test/", 200, None, html), ("http://10.0.0.1/", 200, "text/html", html), ("https://n.test/", 500, "text/html", html), ("https://n.test/", 200, "TEXT/HTML", "<p>tiny</p>")]
    got = extraction.extract_articles(spark.createDataFrame(rows, "url string, status int, content_type string, html string"), max_chars=50).collect()
    assert [r.input_kind for r in got] == ["fulltext"] + ["excerpt"] * 4
    assert len(got[0].article) == 50 and got[1].reason == "not html (content-type: none)" and got[3].reason == "HTTP 500"
    assert got[4].reason == "extracted only 4 chars (< 200)"


def test_responses(spark):
    raws = [
        '{"summary":"New model","takeaways":["- fast","fast",3,"2. cheap","x","y"]}', '```json\n{"summary":"In a fence"}\n```',
        'Sure: {"summary":"","takeaways":["first","second"]} bye', '["a"]', "Just prose.", '{"summary":"","takeaways":[]}', "   ", '{"summary": 5, "takeaways": "no"}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [(r.summary, r.takeaways) for r in responses.parse_responses(df, 180).orderBy("i").collect()]
    assert got == [
        ("New model", ["fast", "cheap", "x"]), ("In a fence", []), ("first", ["second"]), ('["a"]', []),
        ("Just prose.", []), (None, None), (None, None), (None, None),
    ]


def test_sanitizing(evaluate):
    got = evaluate(lambda c: responses.sanitize_text(c, 200), ["see [here](https://x.test/y) www.z.test/q a.test/b ok", "github.com and 1.5/2.0", "TL;DR: done", "a\u0000b‮c​"])
    assert got == ["see here ok", "github.com and 1.5/2.0", "done", "a bc"]


def test_digest_answers(evaluate):
    got = evaluate(lambda c: responses.parse_digest(c, 100), ['{"digest":"d","summary":"s"}', '{"summary":"s"}', "prose", '{"other":1}'])
    assert got == ["d", "s", "prose", ""]


@pytest.mark.parametrize("unit, limit", [("bytes", 40), ("chars", 25), ("bytes", 3)])
def test_packing_keeps_order_and_size(spark, unit, limit):
    rnd = random.Random(limit)
    blocks = ["".join(rnd.choice("ab汉🙂 ") for _ in range(rnd.randrange(0, 60))) for _ in range(40)]
    chunks = spark.createDataFrame([(blocks,)], "b array<string>").select(documents.pack_blocks(F.col("b"), limit, unit, "|")).first()[0]
    width = (lambda s: len(s.encode())) if unit == "bytes" else len
    assert all(width(c) <= limit or len(c) == 1 for c in chunks)
    assert "".join(chunks).replace("|", "") == "".join(blocks)


def packed(blocks, limit, unit, separator):
    """Chunks by walking over the characters."""
    width = (lambda s: len(s.encode())) if unit == "bytes" else len
    out, open_ = [], ""
    for block in filter(None, blocks):
        if width(block) > limit:
            out += [open_] if open_ else []
            open_, piece = "", ""
            for c in block:
                if piece and width(piece + c) > limit:
                    out.append(piece)
                    piece = ""
                piece += c
            out.append(piece)
        elif open_ and width(open_ + separator + block) <= limit:
            open_ += separator + block
        else:
            out += [open_] if open_ else []
            open_ = block
    return out + ([open_] if open_ else [])


@pytest.mark.parametrize("unit", ["bytes", "chars"])
def test_packing_equals_a_walk_over_characters(spark, unit):
    rnd = random.Random(8)
    lists = [["".join(rnd.choice("abé汉🙂 \r\n\x85\xa0") for _ in range(rnd.randrange(0, 40))) for _ in range(rnd.randrange(9))] for _ in range(150)]
    lists += [[], [""], [None, "a"], ["x" * 300, "y"], ["🙂" * 9], ["a", "汉" * 50, "b", "c"]]
    rows = spark.createDataFrame([(n, b) for n, b in enumerate(lists)], "n int, b array<string>")
    for limit in (1, 2, 3, 7, 30, 64):
        for separator in ("\n\n", "", "·"):
            got = rows.select("n", documents.pack_blocks(F.col("b"), limit, unit, separator).alias("c")).collect()
            for r in got:
                assert r.c == packed(lists[r.n], limit, unit, separator), (limit, separator, lists[r.n])
    assert spark.createDataFrame([(None,)], "b array<string>").select(documents.pack_blocks(F.col("b"))).first()[0] is None


def test_packing_edges(spark):
    pack = lambda b, n: spark.createDataFrame([(b,)], "b array<string>").select(documents.pack_blocks(F.col("b"), n)).first()[0]
    assert pack(["a" * 4096], 4096) == ["a" * 4096]
    assert [len(c) for c in pack(["a" * 4097], 4096)] == [4096, 1]
    assert pack(["ab", "cd", "", "ef"], 6) == ["ab\n\ncd", "ef"]


RSS = """<rss><channel><title>c</title>
<item><title>One &amp; only</title><link>https://n.test/1</link><pubDate>Tue, 20 Aug 2024 01:30:00 GMT</pubDate><description><![CDATA[<p>hi</p>]]></description><author>ann</author></item>
<item><title>No link</title><guid>https://n.test/2</guid></item><item><title>Empty link</title><link></link><guid>g</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A</title><link rel="edit" href="https://e.test/"/><link rel="alternate" href="https://n.test/a"/>
<updated>2024-08-20T01:30:00Z</updated><summary>s</summary><author><name>bob</name></author></entry></feed>"""


def test_feeds_become_items_and_failures_stay_data(spark):
    rows = [("rss", 200, RSS), ("atom", 200, ATOM), ("empty", 200, "<rss><channel></channel></rss>"), ("down", 503, ""), ("bad", 200, "<rss><chan")]
    landing = spark.createDataFrame(rows, "source string, status int, body string").withColumns(
        {"run_id": F.lit("r"), "fetched_at": F.lit("2024-08-21").cast("timestamp")}
    )
    entries, errors = feeds.parse_feeds(landing)
    got = {r.title: r for r in normalize(entries).collect()}
    assert {t: r.url for t, r in got.items()} == {"One & only": "https://n.test/1", "No link": "https://n.test/2", "A": "https://n.test/a"}
    assert got["One & only"].excerpt == "hi" and got["One & only"].author == "ann" and got["A"].author == "bob"
    assert {r.source: r.error for r in errors.collect()} == {"down": "HTTP 503", "bad": "body could not be parsed"}


def test_issue_end_to_end_and_rerun(spark, tmp_path):
    rows = [(f"i{n}", f"Headline number {n} about {w} and nothing else", f"https://n.test/{n}", "s", f"2024-01-30 {n:02}:00:00", float(n), n) for n, w in enumerate(["rain", "gold", "tea", "bears", "rain"])]
    df = spark.createDataFrame(rows, "id string, title string, url string, source string, at string, score double, item_pos long").withColumns(
        {"published_at": F.col("at").cast("timestamp"), "excerpt": F.lit("token sk-abcdefghijklmn")}
    )
    sections = [{"id": "x", "section_pos": 0, "title": "X", "sources": ["s"], "limit": 3, "min_per_source": 0, "include": [], "exclude": [], "enabled": True}]
    run = Run("r", "2024-01-30 12:00:00", "Asia/Shanghai")
    path = str(tmp_path / "archive")
    first = build_issue(df, run, sections, [{"name": "s"}], policy=[{"scope": "section", "key": "x", "summarize": True}])
    for _ in range(2):
        archive.write_archive(first.record, path)
    record = archive.read_archive(spark, path).collect()
    assert len(record) == 1 and record[0].date == "2024-01-30" and record[0].slot is None and record[0].item_count == 3
    assert record[0].items[0].excerpt == "token [REDACTED]"
    assert {r.decision for r in first.tasks.collect()} == {"task"}
    later = build_issue(df, Run("r2", "2024-01-30 13:00:00"), sections, [{"name": "s"}], archive.read_archive(spark, path))
    assert {r.id for r in later.lineup.collect()} == {"i0", "i1"}


def test_unreadable_documents(spark):
    rows = [("2024/01/2024-01-02.json", '{"date":"2024-01-02","items":[]}'), ("2024/01/2024-01-03.eve.json", "{"), ("notes.json", "{}"), ("2024/01/2024-01-01.json", '{"date":"2024-01-01"}')]
    parsed = archive.parse_documents(spark.createDataFrame(rows, "path string, body string"))
    listed = [(r.date, r.slot, r.item_count) for r in archive.list_issues(parsed).collect()]
    assert listed == [("2024-01-03", "eve", 0), ("2024-01-02", None, 0), ("2024-01-01", None, 0)]
    assert {r.path for r in archive.site_issues(parsed)[1].collect()} == {"2024/01/2024-01-03.eve.json", "2024/01/2024-01-01.json"}


def test_neighbours_cross_months(spark):
    df = spark.createDataFrame([("2024-01-31", None), ("2024-02-01", "a"), ("2024-02-01", None)], "date string, slot string")
    got = {(r.date, r.slot): (r.older, r.newer) for r in views.neighbours(df).collect()}
    assert got == {("2024-02-01", None): ("2024-02-01.a", None), ("2024-02-01", "a"): ("2024-01-31", "2024-02-01"), ("2024-01-31", None): (None, "2024-02-01.a")}
