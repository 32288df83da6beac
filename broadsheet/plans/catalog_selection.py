"""Registered queries on filtering, deduplication, ranking and line-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import dedupe, filters, health, normalize, ranking
from broadsheet.operators.topk import places
from broadsheet.plans.catalog_texts import DOCS_SQL, SQL_SPACE, sql_numbers, sql_title_key
from broadsheet.sources import tables
from broadsheet.session import dimension, materialize
from broadsheet.schema import SECTION, SOURCE

NOW = "2024-01-31 00:00:00"
LOOKBACK = 336

SOURCES = [
    {"name": "click", "source_pos": 0, "type": "hackernews", "weight": 1.2, "min_score": 50.0, "fetch_limit": 400, "stale_after_days": 1},
    {"name": "view", "source_pos": 1, "type": "rss", "weight": 1.0, "min_score": None, "fetch_limit": 250, "stale_after_days": None},
    {"name": "error", "source_pos": 2, "type": "rss", "weight": 0.8, "min_score": 0.0, "fetch_limit": 100, "stale_after_days": 7},
    {"name": "purchase", "source_pos": 3, "type": "github", "weight": 1.5, "min_score": 20.0, "fetch_limit": 30, "stale_after_days": 1},
    {"name": "feed", "source_pos": 4, "type": "rss", "weight": 1.0, "min_score": None, "fetch_limit": 10, "stale_after_days": 3},
]
SECTIONS = [
    {"id": "market", "section_pos": 0, "title": "Market", "sources": ["purchase", "signup"], "limit": 15, "min_per_source": 2, "include": [], "exclude": ["7"], "enabled": True},
    {"id": "traffic", "section_pos": 1, "title": "Traffic", "sources": ["click", "view"], "limit": 20, "min_per_source": 3, "include": ["BY 1", "by 2"], "exclude": [], "enabled": True},
    {"id": "mixed", "section_pos": 2, "title": "Mixed", "sources": ["click", "error", "signup"], "limit": 10, "min_per_source": 0, "include": [], "exclude": [], "enabled": True},
    {"id": "off", "section_pos": 3, "title": "Off", "sources": ["error", "feed"], "limit": 5, "min_per_source": 0, "include": [], "exclude": [], "enabled": False},
]
DOC_SOURCES = [
    {"name": f"src{i}", "source_pos": i, "weight": 1.0 + (i % 3) / 10} for i in range(15)
]
THRESHOLD = 0.5


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(sql_value(x) for x in v) + "]::VARCHAR[]"
    return repr(v)


def sql_rows(name: str, rows: list[dict], columns: list[str]) -> str:
    """Configuration rows as a common table expression."""
    body = ", ".join("(" + ", ".join(sql_value(r.get(c)) for c in columns) + ")" for r in rows)
    quoted = ", ".join(f'"{c}"' for c in columns)
    return f"{name}({quoted}) AS (VALUES {body})"


EVENTS_SQL = """
ev AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' by ' || user_id AS title,
  'https://events.example.com/' || event_id AS url, event_type AS source, ts AS published_at,
  value AS score, props AS excerpt, event_id AS item_pos FROM events)"""
SOURCES_SQL = sql_rows(
    "sources",
    SOURCES,
    ["name", "source_pos", "weight", "min_score", "fetch_limit", "stale_after_days"],
)
SECTIONS_SQL = sql_rows(
    "sections",
    [{**s, "max_items": s["limit"], "feeds": s["sources"]} for s in SECTIONS],
    ["id", "section_pos", "title", "feeds", "max_items", "min_per_source", "include", "exclude", "enabled"],
)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.event_items(spark, sf).withColumn("run_id", F.lit("2024-01-31"))


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    return (
        events(spark, sf)
        .withColumn("now", F.lit(NOW).cast("timestamp"))
        .withColumn("lookback_hours", F.lit(LOOKBACK))
    )


def daily_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A backfill: every event takes part in the issues of its own and the next day."""
    day = F.to_date("published_at")
    return (
        tables.event_items(spark, sf)
        .withColumn("day", F.explode(F.sequence(day, F.date_add(day, 1))))
        .withColumn("run_id", F.date_format("day", "yyyy-MM-dd"))
        .withColumn("now", F.date_add("day", 1).cast("timestamp"))
        .withColumn("lookback_hours", F.lit(48))
        .drop("day")
    )


DAILY_SQL = """
runs AS (SELECT ev.*, strftime(day, '%Y-%m-%d') AS run_id, CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AS now_, 48 AS lookback
  FROM ev, LATERAL (SELECT unnest([CAST(published_at AS DATE), CAST(CAST(published_at AS DATE) + INTERVAL 1 DAY AS DATE)]) AS day))"""


def candidates_sql(items: str, wave: str = "enabled") -> str:
    """(item, section) candidates of ``items`` with now_ and lookback."""
    hay = "lower(e.title || chr(10) || coalesce(e.excerpt, ''))"
    return f"""
cand AS (SELECT e.*, s.id AS section, s.section_pos, s.max_items, s.min_per_source, coalesce(f.weight, 1.0) AS weight
  FROM {items} e JOIN (SELECT *, unnest(feeds) AS feed FROM sections WHERE {wave}) s ON s.feed = e.source
  LEFT JOIN sources f ON f.name = e.source
  WHERE e.published_at BETWEEN e.now_ - to_hours(e.lookback) AND e.now_
    AND (coalesce(f.min_score, 0) <= 0 OR coalesce(e.score >= f.min_score, false))
    AND len(list_filter(s.exclude, lambda k: contains({hay}, lower(k)))) = 0
    AND (len(s.include) = 0 OR len(list_filter(s.include, lambda k: contains({hay}, lower(k)))) > 0))"""


def ranked_sql(cand: str = "cand", out: str = "ranked", pct: str = "pct") -> str:
    return f"""
{pct} AS (SELECT *, CASE WHEN score IS NULL THEN 0.5::DOUBLE ELSE
    (rank() OVER (PARTITION BY run_id, section, source ORDER BY score) - 1
     + count(*) OVER (PARTITION BY run_id, section, source, score) / 2)
    / count(score) OVER (PARTITION BY run_id, section, source) END AS percentile FROM {cand}),
{out} AS (SELECT *, floor(weight * (0.6::DOUBLE * percentile + 0.4::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    1 - (((epoch_us(now_) - epoch_us(published_at)) / 1e6::DOUBLE) / 3600) / CAST(lookback AS DOUBLE)))) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS rank_score FROM {pct})"""


def lineup_sql(ranked: str = "ranked", out: str = "lineup", tag: str = "") -> str:
    order = "rank_score DESC, published_at DESC, id ASC"
    return f"""
n1{tag} AS (SELECT *, row_number() OVER (PARTITION BY run_id, section, source ORDER BY {order}) AS nth,
   row_number() OVER (PARTITION BY run_id, section ORDER BY {order}) AS overall FROM {ranked}),
n2{tag} AS (SELECT *, min(overall) OVER (PARTITION BY run_id, section, source) AS best FROM n1{tag}),
n3{tag} AS (SELECT *, row_number() OVER (PARTITION BY run_id, section ORDER BY
   CASE WHEN nth <= min_per_source THEN 0 ELSE 1 END, CASE WHEN nth <= min_per_source THEN nth ELSE overall END,
   CASE WHEN nth <= min_per_source THEN best ELSE 0 END) AS seat FROM n2{tag}),
{out} AS (SELECT *, row_number() OVER (PARTITION BY run_id, section ORDER BY {order}) - 1 AS rank_in_section
  FROM n3{tag} WHERE seat <= max_items)"""


def keyword_matches(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("THE of", "et la", ".*", "ß")])
    docs = tables.document_items(spark, sf)
    return docs.where(filters.matches_any(F.col("title"), F.col("excerpt"), words)).select(
        F.col("item_pos").alias("doc_id"), "title"
    )


KEYWORD_SQL = f"""WITH {DOCS_SQL} SELECT item_pos AS doc_id, title FROM docs
WHERE len(list_filter(['the of', 'et la', '.*', 'ß'], lambda k: contains(lower(title || chr(10) || excerpt), k))) > 0"""


def window_items(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    ev = events(spark, sf)
    return ev.where(filters.within_window(F.col("published_at"), now, F.lit(36))).select("id", "source")


WINDOW_SQL = f"""WITH {EVENTS_SQL} SELECT id, source FROM ev
WHERE published_at BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR AND TIMESTAMP '2024-01-20 12:00:00'"""


def floored_items(spark: SparkSession, sf: str) -> DataFrame:
    ev = filters.with_source_facts(events(spark, sf), filters.source_facts(spark, SOURCES))
    half = F.when(F.col("item_pos") % 10 != 0, F.col("score"))
    return ev.withColumn("score", half).where(
        filters.meets_floor(F.col("score"), F.col("min_score"))
    ).select("id", "weight")


FLOOR_SQL = f"""WITH {EVENTS_SQL}, {SOURCES_SQL}
SELECT id, coalesce(weight, 1.0)::DOUBLE AS weight FROM ev LEFT JOIN sources ON name = source
WHERE coalesce(min_score, 0) <= 0 OR (item_pos % 10 <> 0 AND score >= min_score)"""


def section_filter(spark: SparkSession, sf: str) -> DataFrame:
    live = [s for s in SECTIONS if s["enabled"]]
    out = filters.section_candidates(
        timed_events(spark, sf), live, filters.source_facts(spark, SOURCES)
    )
    return out.select("id", "section", "source")


TIMED_SQL = f"""timed AS (SELECT *, '2024-01-31' AS run_id, TIMESTAMP '{NOW}' AS now_, {LOOKBACK} AS lookback FROM ev)"""
SECTION_FILTER_SQL = f"""WITH {EVENTS_SQL}, {SOURCES_SQL}, {SECTIONS_SQL}, {TIMED_SQL}, {candidates_sql('timed')}
SELECT id, section, source FROM cand"""


def resolved_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Which events a narrowed schedule reads, with lists resolved in columns."""
    kind = F.col("user_id") % 3
    lists = tables.table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.when(kind == 0, F.array(F.lit("*")))
        .otherwise(F.array(F.lit("market"), F.lit("mixed"), F.lit("off")))
        .alias("names"),
        F.when(kind == 1, F.array(F.lit("mixed"), F.lit("traffic"))).alias("override"),
    )
    wanted = filters.resolve_lists(F.col("names"), F.col("override"))
    bridge = dimension(spark, SECTIONS, SECTION).where("enabled").select(
        F.col("id").alias("section"), F.explode("sources").alias("event_type")
    )
    return (
        lists.withColumn("wanted", wanted)
        .join(bridge, "event_type")
        .where(F.array_contains("wanted", "*") | F.array_contains("wanted", F.col("section")))
        .select("event_id", "section")
    )


RESOLVED_SQL = f"""WITH {SECTIONS_SQL}, l AS (SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN ['*']
   WHEN user_id % 3 = 1 THEN ['mixed'] ELSE ['market', 'mixed', 'off'] END AS wanted FROM events)
SELECT event_id, s.id AS section FROM l JOIN (SELECT id, unnest(feeds) AS feed FROM sections WHERE enabled) s ON s.feed = l.event_type
WHERE list_contains(wanted, '*') OR list_contains(wanted, s.id)"""


def pruned_sources(spark: SparkSession, sf: str) -> DataFrame:
    live = [s for s in SECTIONS if s["id"] in ("market", "off")]
    return (
        filters.prune_sources(events(spark, sf), live)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


PRUNED_SQL = "SELECT event_type AS source, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1"


def arrival_limit(spark: SparkSession, sf: str) -> DataFrame:
    limits = dimension(spark, SOURCES, SOURCE).withColumnRenamed("name", "source")
    return normalize.first_per_source(events(spark, sf), limits).select(
        "id", "source", F.col("arrival").cast("bigint").alias("arrival")
    )


ARRIVAL_SQL = f"""WITH {EVENTS_SQL}, {SOURCES_SQL}, r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY item_pos) AS arrival FROM ev)
SELECT id, source, arrival FROM r JOIN sources ON name = source WHERE arrival <= fetch_limit"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    attempts = dimension(spark, SOURCES, SOURCE).select(
        F.lit("2024-01-31").alias("run_id"), F.col("name").alias("source")
    )
    errors = attempts.where(F.col("source") == "error").withColumn("error", F.lit("HTTP 503"))
    return normalize.source_outcomes(attempts, events(spark, sf), errors)


OUTCOMES_SQL = f"""{SOURCES_SQL}, outcomes AS (
  SELECT name AS source, CASE WHEN name = 'error' THEN 'HTTP 503' END AS error,
    CASE WHEN name = 'error' THEN 0 ELSE coalesce(n, 0) END AS n_items, CASE WHEN name <> 'error' THEN latest END AS latest, stale_after_days
  FROM sources LEFT JOIN (SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1) ON event_type = name)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return _outcomes(spark, sf).select(
        "source",
        "error",
        "n_items",
        F.date_format("latest_published_at", "yyyy-MM-dd HH:mm:ss").alias("latest"),
        health.age_label(now, F.col("latest_published_at")).alias("age"),
    )


SOURCE_OUTCOMES_SQL = f"""WITH {OUTCOMES_SQL}
SELECT source, error, n_items, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest,
  CASE WHEN latest IS NULL THEN '—' WHEN h < 24 THEN CAST(floor(h + 0.5) AS INTEGER) || 'h' ELSE CAST(floor(h / 24 + 0.5) AS INTEGER) || 'd' END AS age
FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(latest)) / 1e6 / 3600 AS h FROM outcomes)"""


def stale(spark: SparkSession, sf: str) -> DataFrame:
    late = F.lit("2024-02-08 06:00:00").cast("timestamp")
    found = health.stale_sources(_outcomes(spark, sf), dimension(spark, SOURCES, SOURCE), late)
    return found.select("source", "finding", "message")


STALE_SQL = f"""WITH {OUTCOMES_SQL}, a AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-08 06:00:00') - epoch_us(latest)) / 1e6 / 86400 AS age,
   coalesce(stale_after_days, 30) AS budget FROM outcomes WHERE error IS NULL)
SELECT source, CASE WHEN n_items = 0 THEN 'empty' ELSE 'stale' END AS finding,
  'source "' || source || '"' || CASE WHEN n_items = 0 THEN ' returned 0 items (HTTP was fine — the feed itself is empty or unparseable)'
   ELSE ' looks stale: newest item is ' || CAST(floor(age + 0.5) AS INTEGER) || ' days old (budget ' || budget || 'd)' END AS message
FROM a WHERE n_items = 0 OR age > budget"""


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).withColumn(
        "score", F.when(F.col("item_pos") % 9 != 0, F.floor(F.col("score") / 5))
    )
    return ranking.mid_rank(ev, ["source"]).select("id", "percentile")


PERCENTILE_SQL = f"""WITH {EVENTS_SQL}, s AS (SELECT id, source, CASE WHEN item_pos % 9 <> 0 THEN floor(score / 5) END AS score FROM ev)
SELECT id, CASE WHEN score IS NULL THEN 0.5::DOUBLE ELSE (rank() OVER (PARTITION BY source ORDER BY score NULLS LAST) - 1
  + count(*) OVER (PARTITION BY source, score) / 2) / count(score) OVER (PARTITION BY source) END AS percentile FROM s"""


def recencies(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return events(spark, sf).select(
        "id",
        ranking.round6(ranking.recency(F.col("published_at"), now, F.lit(240.0))).alias("recency"),
        ranking.recency(F.col("published_at"), now, F.lit(0.0)).alias("no_window"),
    )


RECENCY_SQL = f"""WITH {EVENTS_SQL} SELECT id, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - ((epoch_us(TIMESTAMP '2024-01-25 00:00:00') - epoch_us(published_at)) / 1e6::DOUBLE / 3600) / 240.0::DOUBLE)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS recency,
 0.0::DOUBLE AS no_window FROM ev"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    enabled = [s for s in SECTIONS if s["enabled"]]
    return filters.section_candidates(
        daily_runs(spark, sf), enabled, filters.source_facts(spark, SOURCES)
    )


def rank_scores(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ranking.rank_scores(_candidates(spark, sf), ["run_id", "section"])
    return ranked.select("run_id", "section", "id", "rank_score")


_RANKED = f"""WITH {EVENTS_SQL}, {SOURCES_SQL}, {SECTIONS_SQL}, {DAILY_SQL}, {candidates_sql('runs', "enabled")}, {ranked_sql()}"""
RANK_SQL = f"{_RANKED} SELECT run_id, section, id, rank_score FROM ranked"


def daily_lineups(spark: SparkSession, sf: str) -> DataFrame:
    lineup = ranking.section_lineups(_candidates(spark, sf), ["run_id", "section"])
    return lineup.select(
        "run_id", "section", F.col("rank_in_section").cast("bigint").alias("rank_in_section"), "id", "source", "rank_score"
    )


LINEUP_SQL = f"""{_RANKED}, {lineup_sql()}
SELECT run_id, section, rank_in_section, id, source, rank_score FROM lineup"""


def exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.exclusive_lineups(timed_events(spark, sf), SECTIONS, SOURCES).select(
        "section", F.col("rank_in_section").cast("bigint").alias("rank_in_section"), "id", "rank_score"
    )


EXCLUSIVE_SQL = (
    f"WITH {EVENTS_SQL}, {SOURCES_SQL}, {SECTIONS_SQL}, {TIMED_SQL}, "
    + candidates_sql("timed", "id IN ('market', 'traffic')")
    + ", "
    + ranked_sql()
    + ", "
    + lineup_sql()
    + ", remaining AS (SELECT * FROM timed WHERE id NOT IN (SELECT id FROM lineup)), "
    + candidates_sql("remaining", "id = 'mixed'").replace("cand AS", "cand2 AS")
    + ", "
    + ranked_sql("cand2", "ranked2", "pct2")
    + ", "
    + lineup_sql("ranked2", "lineup2", "b")
    + " SELECT section, rank_in_section, id, rank_score FROM lineup UNION ALL"
    " SELECT section, rank_in_section, id, rank_score FROM lineup2"
)


def placed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items of many bodies: positions restart in every hundred. What is compared
    later is the title, so the texts are not carried along."""
    docs = tables.document_items(spark, sf).drop("excerpt", "lang").withColumnRenamed("item_pos", "doc_id")
    return docs.withColumns(
        {"run_id": F.lit("r"), "body_pos": F.floor(F.col("doc_id") / 100), "item_pos": F.col("doc_id") % 100}
    )


def doc_facts(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.with_title_facts(dedupe.with_trust_key(placed_documents(spark, sf), DOC_SOURCES))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.history_facts(tables.benchmark_items(spark, sf))


_DOC_SOURCES_SQL = sql_rows("doc_sources", DOC_SOURCES, ["name", "source_pos", "weight"])
FACTS_SQL = f"""{DOCS_SQL}, {_DOC_SOURCES_SQL},
facts AS (SELECT id, title, source, item_pos, {sql_title_key('title')} AS title_key, coalesce({sql_numbers('title')}, '') AS numbers,
  row_number() OVER (ORDER BY -coalesce(weight, 1.0), coalesce(source_pos, 15), source, item_pos) AS ord
  FROM docs LEFT JOIN doc_sources ON name = source),
hist AS (SELECT substr(sha256(text), 1, 16) AS id, trim(regexp_extract(text, '^[^.!?\\n]*')) AS title FROM benchmark),
hfacts AS (SELECT id, title, {sql_title_key('title')} AS title_key, coalesce({sql_numbers('title')}, '') AS numbers FROM hist)"""
_JOINED = f"regexp_replace(title_key, '[{SQL_SPACE}]+', '', 'g') AS joined"
_GRAM_LIST = """list_distinct(list_transform(range(1, greatest(length(joined) - 2, 1)), lambda i: substr(joined, i, 4)))"""
PAIRS_SQL = f"""{FACTS_SQL},
nodes AS (SELECT title_key, numbers, min(ord) AS node FROM facts GROUP BY 1, 2),
grams AS (SELECT node, numbers, title_key, {_GRAM_LIST} AS grams FROM (SELECT *, {_JOINED} FROM nodes)),
posts AS (SELECT node, numbers, len(grams) AS n, unnest(grams) AS gram FROM grams WHERE len(grams) >= 8),
near AS (SELECT a.node AS a_node, b.node AS b_node, 2 * count(*) / (a.n + b.n) AS score
  FROM posts a JOIN posts b ON a.gram = b.gram AND a.numbers = b.numbers AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 2 * count(*) / (a.n + b.n) >= {THRESHOLD}),
hgrams AS (SELECT title_key, numbers, {_GRAM_LIST} AS grams FROM (SELECT DISTINCT title_key, numbers, {_JOINED} FROM hfacts)),
hposts AS (SELECT title_key, numbers, len(grams) AS n, unnest(grams) AS gram FROM hgrams WHERE len(grams) >= 8),
hnear AS (SELECT DISTINCT node FROM (SELECT p.node FROM posts p JOIN hposts h ON p.gram = h.gram AND p.numbers = h.numbers
  GROUP BY p.node, h.title_key, p.n, h.n HAVING 2 * count(*) / (p.n + h.n) >= {THRESHOLD}))"""


def trust_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's place by trust, over all and inside its source, and its source's rank."""
    docs = dedupe.with_trust_key(placed_documents(spark, sf), DOC_SOURCES).select("doc_id", "source", "source_rank", "trust")
    inside = places(docs, "trust", ["source"], "place_in_source")
    return places(inside, "trust", [], "place").drop("trust")


TRUST_SQL = f"""WITH {DOCS_SQL}, {_DOC_SOURCES_SQL}, r AS (SELECT name, dense_rank() OVER (ORDER BY -weight, source_pos) - 1 AS source_rank
   FROM (SELECT * FROM doc_sources UNION ALL SELECT NULL, 15, 1.0))
SELECT item_pos AS doc_id, source, source_rank, row_number() OVER (PARTITION BY source ORDER BY item_pos) AS place_in_source,
  row_number() OVER (ORDER BY source_rank, source, item_pos) AS place FROM (
  SELECT source, item_pos, coalesce(r.source_rank, (SELECT source_rank FROM r WHERE name IS NULL)) AS source_rank
  FROM docs LEFT JOIN r ON r.name = docs.source)"""


def published(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents (odd ids) as history of all of them."""
    facts = doc_facts(spark, sf)
    old = facts.where(F.col("doc_id") % 2 == 1).select("id", "title_key")
    new = facts.where(F.col("doc_id") % 2 == 0)
    return dedupe.unseen(new, old).select(F.col("doc_id"), "id")


PUBLISHED_SQL = f"""WITH {FACTS_SQL}, old AS (SELECT * FROM facts WHERE item_pos % 2 = 1)
SELECT item_pos AS doc_id, id FROM facts WHERE item_pos % 2 = 0 AND id NOT IN (SELECT id FROM old)
 AND (title_key = '' OR title_key NOT IN (SELECT title_key FROM old))"""


def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    facts = materialize(doc_facts(spark, sf), "facts")
    pairs = dedupe.near_pairs(facts, THRESHOLD)
    at = facts.select("trust", "doc_id")
    return (
        pairs.join(at.select(F.col("trust").alias("a_node"), F.col("doc_id").alias("first_doc")), "a_node")
        .join(at.select(F.col("trust").alias("b_node"), F.col("doc_id").alias("second_doc")), "b_node")
        .select("first_doc", "second_doc", "score")
    )


NEAR_SQL = f"""WITH {PAIRS_SQL} SELECT x.item_pos AS first_doc, y.item_pos AS second_doc, score
FROM near JOIN facts x ON x.ord = a_node JOIN facts y ON y.ord = b_node"""


def near_history(spark: SparkSession, sf: str) -> DataFrame:
    facts = materialize(doc_facts(spark, sf), "facts")
    near = dedupe.near_published(facts, history(spark, sf), THRESHOLD)
    return facts.join(near, ["title_key", "numbers"], "left_semi").select(
        F.col("doc_id"), "title_key"
    )


NEAR_HISTORY_SQL = f"""WITH {PAIRS_SQL} SELECT f.item_pos AS doc_id, f.title_key FROM facts f
JOIN nodes n ON n.title_key = f.title_key AND n.numbers = f.numbers JOIN hnear h ON h.node = n.node"""


def _exact_only(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.label_drops(doc_facts(spark, sf), None, 0)


def exact_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _exact_only(spark, sf).select(F.col("doc_id"), "cause")


# One step per item in trust order, against the ids and titles kept so far.
EXACT_SQL = f"""WITH RECURSIVE {FACTS_SQL},
walk AS (SELECT 0::BIGINT AS ord, ''::VARCHAR AS id, []::VARCHAR[] AS ids, []::VARCHAR[] AS titles, false AS kept
  UNION ALL
  SELECT f.ord, f.id, CASE WHEN k THEN list_append(w.ids, f.id) ELSE w.ids END,
    CASE WHEN k THEN list_append(w.titles, f.title_key) ELSE w.titles END, k
  FROM walk w JOIN (SELECT ord, id, title_key FROM facts) f ON f.ord = w.ord + 1,
  LATERAL (SELECT NOT list_contains(w.ids, f.id) AND (f.title_key = '' OR NOT list_contains(w.titles, f.title_key)) AS k))
SELECT item_pos AS doc_id, CASE WHEN NOT w.kept THEN 'within' END AS cause FROM walk w JOIN facts f ON f.ord = w.ord"""


def drop_causes(spark: SparkSession, sf: str) -> DataFrame:
    labelled = dedupe.label_drops(doc_facts(spark, sf), history(spark, sf), THRESHOLD)
    return labelled.select(F.col("doc_id"), "cause")


# The kept items so far are carried as nodes, ids and titles; rules in the given order.
_DEDUPE_WALK = f"""WITH RECURSIVE {PAIRS_SQL},
nbr AS (SELECT node, list(other) AS others FROM (SELECT a_node AS node, b_node AS other FROM near
   UNION ALL SELECT b_node, a_node FROM near) GROUP BY 1),
it AS (SELECT f.ord, f.item_pos, f.id, f.title_key, n.node, coalesce(b.others, []) AS others,
   f.id IN (SELECT id FROM hfacts) OR (f.title_key <> '' AND f.title_key IN (SELECT title_key FROM hfacts)) AS seen,
   n.node IN (SELECT node FROM hnear) AS hn,
   n.node IN (SELECT node FROM posts) AS sized
  FROM facts f JOIN nodes n ON n.title_key = f.title_key AND n.numbers = f.numbers LEFT JOIN nbr b ON b.node = n.node),
walk AS (SELECT 0::BIGINT AS ord, []::VARCHAR[] AS ids, []::VARCHAR[] AS titles, []::BIGINT[] AS kept_nodes, ''::VARCHAR AS verdict
  UNION ALL
  SELECT i.ord, CASE WHEN v = 'kept' THEN list_append(w.ids, i.id) ELSE w.ids END,
   CASE WHEN v = 'kept' THEN list_append(w.titles, i.title_key) ELSE w.titles END,
   CASE WHEN v = 'kept' THEN list_append(w.kept_nodes, i.node) ELSE w.kept_nodes END, v
  FROM walk w JOIN it i ON i.ord = w.ord + 1,
  LATERAL (SELECT CASE WHEN i.seen THEN 'seen'
    WHEN list_contains(w.ids, i.id) OR (i.title_key <> '' AND list_contains(w.titles, i.title_key)) THEN 'within'
    WHEN i.hn THEN 'seen' WHEN list_has_any(w.kept_nodes, i.others) THEN 'within' ELSE 'kept' END AS v))"""
CAUSES_SQL = f"""{_DEDUPE_WALK}
SELECT item_pos AS doc_id, nullif(verdict, 'kept') AS cause FROM walk JOIN it ON it.ord = walk.ord"""


def drop_counts(spark: SparkSession, sf: str) -> DataFrame:
    labelled = dedupe.label_drops(doc_facts(spark, sf), history(spark, sf), THRESHOLD)
    return dedupe.drop_counts(labelled).drop("run_id")


COUNTS_SQL = f"""{_DEDUPE_WALK}, verdicts AS (SELECT item_pos, verdict FROM walk JOIN it ON it.ord = walk.ord)
SELECT count(*) FILTER (verdict = 'within') AS dropped_within_run, count(*) FILTER (verdict = 'seen') AS dropped_as_seen,
 count(*) FILTER (verdict = 'kept') AS kept FROM verdicts"""


def survivors(spark: SparkSession, sf: str) -> DataFrame:
    facts = doc_facts(spark, sf)
    kept = dedupe.survivors(facts, THRESHOLD)
    return kept.join(facts.select("trust", "doc_id"), "trust").select("doc_id", "id", "title_key")


SURVIVORS_SQL = f"""{_DEDUPE_WALK.replace("i.seen THEN", "false THEN").replace("i.hn THEN", "false THEN")}
SELECT item_pos AS doc_id, id, title_key FROM walk JOIN it ON it.ord = walk.ord WHERE verdict = 'kept'"""


def number_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal number keys over whole texts."""
    from broadsheet.functions.text import title_numbers

    return (
        tables.table(spark, sf, "documents")
        .groupBy(title_numbers(F.col("text")).alias("numbers"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    )


NUMBERS_SQL = f"""SELECT coalesce({sql_numbers('text')}, '') AS numbers, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"""


def source_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.document_items(spark, sf)
    facts = filters.source_facts(spark, DOC_SOURCES)
    return (
        filters.with_source_facts(docs, facts)
        .groupBy("weight")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))
    )


SOURCE_JOIN_SQL = f"""WITH {_DOC_SOURCES_SQL} SELECT coalesce(weight, 1.0)::DOUBLE AS weight, count(*) AS n, count(DISTINCT source) AS n_sources
FROM documents LEFT JOIN doc_sources ON name = source GROUP BY 1"""


def all_items(spark: SparkSession, sf: str) -> DataFrame:
    """The union of every kind of item, by source."""
    columns = ["id", "title", "source", "excerpt"]
    docs = tables.document_items(spark, sf).select(*columns)
    return (
        tables.event_items(spark, sf)
        .select(*columns)
        .unionByName(docs)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    )


ALL_SQL = f"""WITH {EVENTS_SQL}, {DOCS_SQL} SELECT source, count(*) AS n, min(id) AS first_id
FROM (SELECT id, source FROM ev UNION ALL SELECT id, source FROM docs) GROUP BY 1"""


def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Top reasons of failed events per day, with the alert gate over all attempts."""
    ev = tables.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("user "), F.col("user_id") % 10).alias("message"),
        (F.col("value") > 40).alias("ok"),
    )
    alarming = health.majority_failed(ev, ["run_id"])
    reasons = health.top_reasons(ev.where(~F.col("ok")), ["run_id"], 3)
    return health.reason_warnings(reasons.join(alarming, "run_id", "left_semi"), "extract").select(
        "run_id", F.col("rank").cast("bigint").alias("rank"), "n", "warning"
    )


REASONS_SQL = """WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id AS pos, 'user ' || (user_id % 10) AS message, value > 40 AS ok FROM events),
g AS (SELECT run_id FROM a GROUP BY 1 HAVING count(*) FILTER (NOT ok) > count(*) FILTER (ok)),
c AS (SELECT run_id, message, count(*) AS n, min(pos) AS p FROM a WHERE NOT ok GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, p) AS rank FROM c)
SELECT run_id, rank, n, 'extract: ' || n || ' item(s) fell back to the source excerpt — ' || message AS warning
FROM r WHERE rank <= 3 AND run_id IN (SELECT run_id FROM g)"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    runs = daily_runs(spark, sf)
    measures = {
        "fetched": F.count(F.lit(1)),
        "scored": F.count("score"),
        "sources": F.count_if(F.col("source") == "click"),
    }
    return health.run_metrics("fetch", runs, measures)


METRICS_SQL = f"""WITH {EVENTS_SQL}, {DAILY_SQL}, m AS (SELECT run_id, count(*) AS a, count(score) AS b, count(*) FILTER (source = 'click') AS c FROM runs GROUP BY 1)
SELECT run_id, 'fetch' AS stage, 'fetched' AS metric, a::DOUBLE AS value FROM m
UNION ALL SELECT run_id, 'fetch', 'scored', b::DOUBLE FROM m UNION ALL SELECT run_id, 'fetch', 'sources', c::DOUBLE FROM m"""

QUERIES = {
    "keyword_match": (keyword_matches, KEYWORD_SQL),
    "time_window": (window_items, WINDOW_SQL),
    "score_floor": (floored_items, FLOOR_SQL),
    "section_filter": (section_filter, SECTION_FILTER_SQL),
    "resolve_sections": (resolved_sections, RESOLVED_SQL),
    "prune_sources": (pruned_sources, PRUNED_SQL),
    "arrival_limit": (arrival_limit, ARRIVAL_SQL),
    "source_outcomes": (outcomes, SOURCE_OUTCOMES_SQL),
    "stale_sources": (stale, STALE_SQL),
    "mid_rank": (percentiles, PERCENTILE_SQL),
    "recency": (recencies, RECENCY_SQL),
    "rank_score": (rank_scores, RANK_SQL),
    "quota_lineup": (daily_lineups, LINEUP_SQL),
    "exclusive_sections": (exclusive, EXCLUSIVE_SQL),
    "trust_order": (trust_order, TRUST_SQL),
    "already_published": (published, PUBLISHED_SQL),
    "number_guard": (number_guard, NUMBERS_SQL),
    "near_title_pairs": (near_pairs, NEAR_SQL),
    "near_history": (near_history, NEAR_HISTORY_SQL),
    "exact_dedupe": (exact_dedupe, EXACT_SQL),
    "survivors": (survivors, SURVIVORS_SQL),
    "drop_causes": (drop_causes, CAUSES_SQL),
    "drop_counts": (drop_counts, COUNTS_SQL),
    "source_join": (source_join, SOURCE_JOIN_SQL),
    "union_items": (all_items, ALL_SQL),
    "failure_reasons": (failure_reasons, REASONS_SQL),
    "run_metrics": (metrics, METRICS_SQL),
}
