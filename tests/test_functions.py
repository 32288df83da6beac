import datetime as dt

from pyspark.sql import functions as F

from broadsheet.functions import redact, text, times, urls


def test_canonical_urls_name_one_document(evaluate):
    cases = {
        "https://news.test/p?utm_campaign=z&fbclid=1": "news.test/p",
        "http://WWW.News.test/P/": "news.test/P",
        "https://news.test:443/p#top": "news.test/p",
        "https://news.test:8080/p": "news.test:8080/p",
        "https://news.test/p?z=1&a=2&a=1": "news.test/p?a=1&a=2&z=1",
        "https://news.test/a/../b/./c": "news.test/b/c",
        "https://news.test/x y?q=a%20b+c&flag": "news.test/x%20y?flag=&q=a b c",
        "No Url Here//": "no url here",
    }
    assert evaluate(urls.canonical_url, list(cases)) == list(cases.values())


def test_item_id_is_shared_by_equivalent_urls(evaluate):
    a, b = evaluate(urls.item_id, ["http://www.n.test/x/?ref=1", "https://N.test/x"])
    assert a == b and len(a) == 16


def test_fetchable_addresses(evaluate):
    refused = [
        "http://localhost/", "http://10.1.2.3/", "http://172.20.0.1/", "http://192.168.0.9/",
        "http://169.254.1.1/", "http://100.100.0.1/", "http://0.0.0.0/", "http://[::1]/",
        "http://[::ffff:10.0.0.1]/", "http://[::ffff:a00:1]/", "http://[fc00::1]/",
        "http://db.internal/", "http://x.local/", "ftp://n.test/", "mailto:a@n.test",
        "https://u:p@n.test/", "plain words",
    ]
    allowed = ["https://n.test/a?b=c", "https://172.32.0.1/", "https://[2001:db8::1]/", "http://11.0.0.1/"]
    assert evaluate(urls.is_fetchable, refused) == [False] * len(refused)
    assert evaluate(urls.is_fetchable, allowed) == [True] * len(allowed)


def test_entities_and_html(evaluate):
    got = evaluate(
        text.strip_html,
        ["<p>a&nbsp;&mdash; b</p>", "&#8212;&#x2014;", "&prime;&Prime;&COPY;", "&nope; &#1114112;", "x&shy;y &amp;lt;", None],
    )
    assert got == ["a — b", "——", "′″©", "&nope; &#1114112;", "xy &lt;", None]


def test_truncate(evaluate):
    cut = lambda n, s: evaluate(lambda c: text.truncate(c, n), [s])[0]
    assert cut(20, "short") == "short"
    assert cut(30, "One whole sentence. And then far more text follows here.") == "One whole sentence."
    assert cut(10, "一二三四五六。七八九十一二") == "一二三四五六。"
    assert cut(30, "Come by, i.e. soon, since the shop closes early today.").endswith("…")
    assert cut(24, "alpha bravo charlie delta echo") == "alpha bravo charlie…"
    assert cut(5, "🙂" * 9) == "🙂" * 4 + "…"
    assert len(cut(50, "Tiny one. " + "y" * 400)) == 50


def test_boilerplate_runs_in_order_and_ignores_case(spark):
    df = spark.createDataFrame([("Keep DROP - Site", ["drop", r" - site$"]), ("Comments", ["^comments$"]), ("as is", None)], "t string, p array<string>")
    got = [r[0] for r in df.select(text.strip_boilerplate(F.col("t"), F.col("p"))).collect()]
    assert got == ["Keep", "", "as is"]


def test_title_keys_fold_case_width_and_marks(evaluate):
    got = evaluate(text.title_key, ["Rust 1.9:  OUT!", "ＦＵＬＬ ﬁne", "「早报」要闻", "!!!"])
    assert got == ["rust 1 9 out", "full fine", "早报 要闻", ""]


def test_grams_are_distinct_and_survive_piece_borders(evaluate):
    long = "".join(chr(97 + (i * 7 + i // 11) % 26) for i in range(700))
    got = evaluate(text.key_grams, ["abc", "abcd ef", long])
    assert got[0] == [] and got[1] == ["abcd", "bcde", "cdef"]
    assert set(got[2]) == {long[i : i + 4] for i in range(len(long) - 3)}


def test_languages_tokens_and_numbers(evaluate):
    assert evaluate(text.title_language, ["公测大招 abc", "plain", "123"]) == ["zh", "other", "other"]
    assert evaluate(text.token_estimate, ["abcd", "汉字abcde", ""]) == [1, 4, 0]
    assert evaluate(text.title_numbers, ["v2 of 10 and 1", "none"]) == ["1,10,2", ""]
    assert evaluate(text.utf16_length, ["a🙂é"]) == [4]


def test_publish_times(evaluate):
    run = F.lit("2000-01-01").cast("timestamp")
    got = evaluate(
        lambda c: times.published_at(c, run),
        ["Tue, 20 Aug 2024 01:30:00 GMT", "20 Aug 2024 01:30:00 +0800", "2024-08-20T01:30:00Z", "2024-08-20", "soon", "", None],
    )
    day = dt.datetime(2024, 8, 20)
    fallback = dt.datetime(2000, 1, 1)
    assert got == [
        day + dt.timedelta(hours=1, minutes=30), day - dt.timedelta(hours=6, minutes=30),
        day + dt.timedelta(hours=1, minutes=30), day, fallback, fallback, fallback,
    ]
    epoch = evaluate(lambda c: times.published_at_epoch(c, run), [1.7e9, 1.7e12, None], "double")
    assert epoch[0] == epoch[1] and epoch[2] == fallback


def test_local_date_crosses_midnight(evaluate):
    at = [dt.datetime(2024, 1, 1, 23, 10)]
    assert evaluate(lambda c: times.local_date(c, F.lit("Asia/Shanghai")), at, "timestamp") == ["2024-01-02"]


def test_redaction_shapes_and_values(evaluate):
    got = evaluate(
        lambda c: redact.redact(c, ["p@ss/word", "pass"]),
        ["p@ss/word p%40ss%2Fword", "x?token=abc&a=1", "sk-abcdefghijkl12 re_short", "https://u:pw@h.test/"],
    )
    assert got == ["[REDACTED] [REDACTED]", "x?token=[REDACTED]&a=1", "[REDACTED] re_short", "https://[REDACTED]@h.test/"]


def test_redaction_reaches_every_string(spark):
    df = spark.sql("select named_struct('a', array('k hunter22'), 'm', map('x', 'hunter22')) as row, 1 as n")
    out = redact.redact_rows(df, ["hunter22"]).first()
    assert out.row.a == ["k [REDACTED]"] and out.row.m == {"x": "[REDACTED]"} and out.n == 1


def test_dates_as_feeds_write_them(evaluate):
    from broadsheet.functions.times import published_at

    run = F.lit("2024-02-01 00:00:00").cast("timestamp")
    texts = {
        "Mon, 15 Jan 24 10:00:00 GMT": "2024-01-15 10:00:00",
        "2024-01-15T10:00Z": "2024-01-15 10:00:00",
        "Tue, 16 Jan 2024 9:05:00 +0000": "2024-01-16 09:05:00",
        "15 January 2024 10:00:00 GMT": "2024-01-15 10:00:00",
        "January 15, 2024 10:00:00": "2024-01-15 10:00:00",
        "2024/01/15 10:00:00": "2024-01-15 10:00:00",
        "Jan 15 2024": "2024-01-15 00:00:00",
        "Mon Jan 15 2024 10:00:00 GMT+0000": "2024-01-15 10:00:00",
        "Mon, 15 Jan 2024 10:00:00 EDT": "2024-01-15 14:00:00",
        "15-Jan-99 10:00 PST": "1999-01-15 18:00:00",
        "2024-01-15 10:00:00.123+02:00": "2024-01-15 08:00:00",
        "Mon, 15 Jan 2024 10:00:00 XQZ": "2024-02-01 00:00:00",
        "31 Feb 2024": "2024-02-01 00:00:00",
        "soon": "2024-02-01 00:00:00",
    }
    got = evaluate(lambda t: F.date_format(published_at(t, run), "yyyy-MM-dd HH:mm:ss"), list(texts))
    assert dict(zip(texts, got)) == texts


def test_numbers_no_calendar_holds_fall_back(evaluate):
    from broadsheet.functions.times import published_at_epoch

    run = F.lit("2024-02-01 00:00:00").cast("timestamp")
    shown = lambda n: F.date_format(published_at_epoch(n, run), "yyyy-MM-dd")
    values = [float("nan"), 1e20, 1e300, float("inf"), None, 1705312800.0, 1705312800000.0]
    assert evaluate(shown, values, "double") == ["2024-02-01"] * 5 + ["2024-01-15"] * 2


def test_host_spellings(evaluate):
    from broadsheet.functions.urls import canonical_url, is_fetchable, item_id

    private = "2130706433 127.1 0x7f000001 0177.0.0.1 127.0.0.1. 10.1 2852039166 [0:0:0:0:0:0:0:1] [0:0:0:0:0:ffff:7f00:1] [::ffff:10.0.0.1] [fe80::1] [::] [1::2::3] 256.1.1.1".split()
    public = "134744072 8.8.8.8 8.8.2056 0x08080808 010.8.8.8 [2606:4700::1111] [::ffff:8.8.8.8] example.com 1.example.com".split()
    assert evaluate(is_fetchable, [f"http://{h}/" for h in private + public]) == [False] * len(private) + [True] * len(public)
    assert set(evaluate(canonical_url, [f"http://{h}/a" for h in public[:5]])) == {"8.8.8.8/a"}
    long = "http://x.com/?q=" + "a" * 1_100_000
    assert len(set(evaluate(item_id, [long + "1", long + "2"]))) == 2


def test_letters_behind_a_numeric_reference(evaluate):
    from broadsheet.functions.text import decode_entities

    assert evaluate(decode_entities, ["&#65ab;", "&#x41;", "&#ab;", "&#065;"]) == ["A", "A", "&#ab;", "A"]


def test_an_explicit_null_digest_gives_way(evaluate):
    from broadsheet.operators.responses import parse_digest

    texts = ['{"digest":null,"summary":"s"}', '{"digest":"d","summary":"s"}', '{"digest":7,"summary":"s"}', "prose"]
    assert evaluate(lambda t: parse_digest(t, 100), texts) == ["s", "d", "", "prose"]


def test_a_text_is_prepared_once_however_it_is_cut(spark):
    from pyspark.sql import functions as F

    from broadsheet.functions import text as tx

    df = spark.createDataFrame([("a  b. " * 100,), ("short",), (None,)], "t string")
    cut = df.select(tx.truncate(F.reverse(F.reverse("t")), 30).alias("cut"))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1
    assert [r.cut for r in cut.collect()][1:] == ["short", None]
