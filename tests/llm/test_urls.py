import math
import re
from collections import Counter

import llm_paths  # noqa: F401
from pyspark.sql import functions as F
from texts import frame

from broadsheet.llm import urls as U

SCHEMA = "page_id bigint, url string"
URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/7?x=/en/", "http://a.example.com/en/71", "https://x.com/en/", "https://x.com/en",
    "https://xcom/en/", "http://com/en/9", "ftp://e.net/de/8", "ftp://b.example.net/de/8#q", "http://q.org/es/?a=1&b=2", "http://É.org/es/ü", "a://b://c/d",
    "http://h?no/path", "http://h#f/x", "http://user@h.com:80/en/", "x" * 5000, "http://10.0.0.1/" + "a/" * 400, "http://k.net/de/8\nnext",
]


def plain(url):
    """Host, path and rule by string search."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split("[?#]", rest[cut:])[0] if rest[cut : cut + 1] == "/" else ""
    best = None
    for rule, _ in U.RULES:
        where, prefix = rule.split("/", 1)
        if (host == where or host.endswith("." + where)) and path.startswith("/" + prefix) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_hosts_paths_and_rules(spark):
    data = list(enumerate(URLS)) + [(1, ""), (None, URLS[5])]
    got = U.judged(frame(spark, data, SCHEMA), U.RULES).collect()
    assert len(got) == len(data)
    says = dict(U.RULES)
    for r in got:
        assert (r.host, r.path, r.rule) == plain(r.url), r.url
        assert r.verdict in ("allow", "block") and (r.rule is None) == (r.block_chance is not None)
        assert r.rule is None or r.verdict == says[r.rule]


def test_trees_learn_from_labels(spark):
    good = [(i, f"https://site{i % 9}.org/page/{i % 5}") for i in range(200)]
    bad = [(1000 + i, f"http://x-{i}-win.biz/{i}{i}{i}/a/b/c?i={i}&j={i * 7}&k=1") for i in range(200)]
    rows = frame(spark, good + bad, SCHEMA)
    label = F.when(F.col("page_id") % 2 == 0, F.when(F.col("page_id") < 1000, "allow").otherwise("block"))
    got = U.judged(rows, [], label=label).collect()
    assert all((r.verdict == "block") == (r.page_id >= 1000) for r in got)


def test_features_equal_plain_counting(spark):
    rows = frame(spark, list(enumerate(URLS)), SCHEMA).withColumns({"host": U.host_of(F.col("url")), "path": U.path_of(F.col("url"))})
    for r in U.featured(rows, "url").collect():
        url = r.url or ""
        n = len(url)
        share = [c / n for c in Counter(url).values()]
        assert math.isclose(r.entropy, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        assert r.length == n and math.isclose(r.digit_share, sum(c in "0123456789" for c in url) / n if n else 0.0)
        assert r.depth == len(re.findall("/[^/]", r.path)) and r.hyphens == r.host.count("-")


def test_one_kind_of_label_empty_and_clashing(spark):
    one = U.judged(frame(spark, [(1, "http://x.com/en/a"), (2, "http://y.fr/")], SCHEMA), [("com/en/", "block")]).collect()
    assert {r.page_id: r.verdict for r in one} == {1: "block", 2: "allow"}
    assert U.judged(frame(spark, [], SCHEMA), U.RULES).count() == 0
    clash = frame(spark, list(enumerate(URLS)), SCHEMA).withColumns({"host": F.lit(1), "verdict": F.lit(2), "probability": F.lit(3), "length": F.lit(4)})
    assert U.judged(clash, U.RULES).columns == ["page_id", "url", "probability", "host", "path", "rule", "verdict", "block_chance"]
