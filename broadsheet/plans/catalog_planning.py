"""Registered queries on summary planning, documents and landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.times import published_at
from broadsheet.operators import documents, planning, responses
from broadsheet.operators.normalize import source_outcomes
from broadsheet.operators.planning import Budget, Gate
from broadsheet.plans.catalog_selection import sql_rows
from broadsheet.plans.catalog_texts import sql_truncate
from broadsheet.schema import SOURCE
from broadsheet.session import dimension, materialize
from broadsheet.sources import feeds, tables

PER_RUN = 40
SECTION_IDS = ["lead", "notes", "rest"]
POLICY = [
    {"scope": "section", "key": "lead", "summarize": True, "style": "tldr", "max_chars": 90},
    {"scope": "section", "key": "notes", "summarize": True, "fetch_full_text": True},
    {"scope": "source", "key": "src1", "summarize": False},
    {"scope": "source", "key": "src2", "summarize": True, "language": "en", "fetch_full_text": False},
    {"scope": "source", "key": "src3", "style": "oneline"},
]
GATE = Gate(top_per_section=12, title_language_not="zh", excerpt_shorter_than=1500, excerpt_matches=["tionally", "^an"])
BUDGET = Budget(max_items=12, max_chars_per_item=900, max_total_chars=6000)

LINEUP_SQL = f"""
lineup AS (SELECT doc_id, 'run-' || (doc_id // {PER_RUN}) AS run_id, CAST(doc_id AS VARCHAR) AS id, source, text AS excerpt,
  trim(regexp_extract(text, '^[^.!?\\n]*')) AS title, (doc_id % {PER_RUN}) % 3 AS section_pos, (doc_id % {PER_RUN}) // 3 AS rank_in_section,
  ['lead', 'notes', 'rest'][(doc_id % {PER_RUN}) % 3 + 1] AS section FROM documents)"""


def lineup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ready line-ups: forty per run, dealt to three sections."""
    docs = tables.document_items(spark, sf)
    at = F.col("item_pos") % PER_RUN
    return docs.select(
        F.concat(F.lit("run-"), F.floor(F.col("item_pos") / PER_RUN).cast("string")).alias("run_id"),
        F.col("item_pos").cast("string").alias("id"),
        "title",
        "source",
        "excerpt",
        F.element_at(F.array(*[F.lit(s) for s in SECTION_IDS]), (at % 3 + 1).cast("int")).alias("section"),
        (at % 3).cast("int").alias("section_pos"),
        F.floor(at / 3).cast("int").alias("rank_in_section"),
    )


POLICY_SQL = sql_rows(
    "policy", POLICY, ["scope", "key", "summarize", "style", "language", "max_chars", "fetch_full_text"]
)
RESOLVED_SQL = f"""{LINEUP_SQL}, {POLICY_SQL},
resolved AS (SELECT l.*, coalesce(a."summarize", b."summarize", false) AS "summarize", coalesce(a.style, b.style, 'bullet') AS style,
  coalesce(a.language, b.language, 'zh-CN') AS language, coalesce(a.max_chars, b.max_chars, 180) AS max_chars,
  coalesce(a.fetch_full_text, b.fetch_full_text, false) AS fetch_full_text
  FROM lineup l LEFT JOIN policy a ON a.scope = 'source' AND a.key = l.source LEFT JOIN policy b ON b.scope = 'section' AND b.key = l.section)"""
GATED_SQL = rf"""{RESOLVED_SQL},
gated AS (SELECT *, "summarize" AND rank_in_section < 12
  AND NOT coalesce(len(regexp_extract_all(title, '\p{{Han}}')) / nullif(len(regexp_extract_all(title, '\p{{L}}')), 0) >= 0.3, false)
  AND (fetch_full_text OR trim(excerpt) = '' OR length(excerpt) < 1500 OR regexp_matches(excerpt, '(?i)tionally') OR regexp_matches(excerpt, '(?i)^an')) AS candidate
  FROM resolved)"""


def policies(spark: SparkSession, sf: str) -> DataFrame:
    out = planning.with_policy(lineup(spark, sf), POLICY)
    return out.select("id", "summarize", "style", "language", F.col("max_chars").cast("bigint").alias("max_chars"), "fetch_full_text")


POLICIES_SQL = f'''WITH {RESOLVED_SQL} SELECT id, "summarize", style, language, max_chars, fetch_full_text FROM resolved'''


def gate(spark: SparkSession, sf: str) -> DataFrame:
    out = planning.gated(planning.with_policy(lineup(spark, sf), POLICY), GATE)
    return out.select("id", "candidate")


GATE_SQL = f"WITH {GATED_SQL} SELECT id, candidate FROM gated"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    out = planning.gated(planning.with_policy(lineup(spark, sf), POLICY), GATE).where("candidate")
    return planning.with_turn(out).select("run_id", F.col("turn").cast("bigint").alias("turn"), "id")


_TURNS = f"""{GATED_SQL}, turns AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank_in_section, section_pos) - 1 AS turn FROM gated WHERE candidate)"""
TURNS_SQL = f"WITH {_TURNS} SELECT run_id, turn, id FROM turns"


def budget(spark: SparkSession, sf: str) -> DataFrame:
    plan = planning.plan_tasks(lineup(spark, sf), POLICY, GATE, BUDGET)
    return plan.select(
        "id",
        "decision",
        F.col("reserved_chars").cast("bigint").alias("reserved_chars"),
        F.when(F.col("decision") == "task", planning.estimated_tokens()).alias("tokens"),
    )


def _sql_tokens(x: str) -> str:
    cjk = rf"len(regexp_extract_all({x}, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]'))"
    return f"CAST(ceil({cjk} + (length({x}) - {cjk}) / 4) AS BIGINT)"


_BUDGET = f"""WITH RECURSIVE {_TURNS},
costed AS (SELECT *, left(excerpt, 900) AS input, CASE WHEN fetch_full_text THEN greatest(length(left(excerpt, 900)), 900) ELSE length(left(excerpt, 900)) END AS reserved FROM turns),
walk AS (SELECT DISTINCT run_id, -1::BIGINT AS turn, 0::BIGINT AS tasks, 0::BIGINT AS chars, ''::VARCHAR AS decision FROM costed
  UNION ALL SELECT c.run_id, c.turn, w.tasks + (v = 'task')::BIGINT, w.chars + CASE WHEN v = 'task' THEN c.reserved ELSE 0 END, v
  FROM walk w JOIN costed c ON c.run_id = w.run_id AND c.turn = w.turn + 1,
  LATERAL (SELECT CASE WHEN w.tasks >= 12 THEN 'capped_by_items' WHEN w.chars + c.reserved > 6000 THEN 'capped_by_chars' ELSE 'task' END AS v))"""
BUDGET_SQL = f"""{_BUDGET}
SELECT c.id, w.decision, reserved AS reserved_chars, CASE WHEN w.decision = 'task' THEN {_sql_tokens('title')}
  + CASE WHEN fetch_full_text THEN CAST(ceil(reserved / 4) AS BIGINT) ELSE {_sql_tokens('input')} END END AS tokens
FROM walk w JOIN costed c ON c.run_id = w.run_id AND c.turn = w.turn
UNION ALL SELECT id, 'gated', NULL, NULL FROM gated WHERE NOT candidate"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    plan = planning.plan_tasks(lineup(spark, sf), POLICY, GATE, BUDGET)
    return responses.request_rows(plan.where(F.col("decision") == "task"))


REQUESTS_SQL = f"""{_BUDGET}
SELECT c.run_id, c.id AS item_id, '1' AS prompt_version, '<<<ITEM_DATA>>>' || chr(10) || '标题：' || title || chr(10) || '来源：' || source || chr(10)
  || '正文：' || CASE WHEN input = '' THEN '(无正文，只有标题)' ELSE input END || chr(10) || '<<<END_ITEM_DATA>>>' AS body
FROM walk w JOIN costed c ON c.run_id = w.run_id AND c.turn = w.turn WHERE w.decision = 'task'"""


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn as the summary of one document: a conversation has up to eight turns."""
    turns = tables.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    at = F.col("conv_id") * 8 + F.col("turn")
    one = turns.groupBy(at.alias("doc")).agg(F.min_by("text", "turn").alias("summary"))
    return one.select(
        F.concat(F.lit("run-"), F.floor(F.col("doc") / PER_RUN).cast("string")).alias("run_id"),
        F.col("doc").cast("string").alias("item_id"),
        "summary",
        F.when(F.col("doc") % 4 == 3, F.split("summary", "\n")).otherwise(F.array().cast("array<string>")).alias("takeaways"),
        F.when(F.col("doc") % 3 == 0, "m-small").otherwise("m-large").alias("model"),
        F.lit("1").alias("prompt_version"),
        F.lit("excerpt").alias("input_kind"),
    )


_SUMMARIES_SQL = """
summaries AS (SELECT doc, min_by(text, turn) AS summary, CASE WHEN doc % 3 = 0 THEN 'm-small' ELSE 'm-large' END AS model
  FROM (SELECT conv_id * 8 + turn AS doc, turn, text FROM conversations WHERE role = 'assistant') GROUP BY doc)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    out = responses.merge_summaries(lineup(spark, sf), _summaries(spark, sf))
    return out.select(
        "id",
        "summary",
        F.coalesce(F.size("takeaways"), F.lit(0)).cast("bigint").alias("n_takeaways"),
        F.col("summary_meta.model").alias("model"),
        responses.effective_body().alias("body"),
    )


MERGED_SQL = f"""WITH {LINEUP_SQL}, {_SUMMARIES_SQL} SELECT id, summary,
  CASE WHEN doc % 4 = 3 THEN len(string_split(summary, chr(10))) ELSE 0 END AS n_takeaways, model, coalesce(summary, excerpt) AS body
FROM lineup LEFT JOIN summaries ON doc = doc_id"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    out = responses.compare_versions(lineup(spark, sf), _summaries(spark, sf), "m-large", "1")
    return out.select("run_id", "id", "title", "excerpt", "summary", "model", "input_kind")


VERSIONS_SQL = f"""WITH {LINEUP_SQL}, {_SUMMARIES_SQL} SELECT run_id, id, title, excerpt, summary, model, 'excerpt' AS input_kind
FROM lineup JOIN summaries ON doc = doc_id WHERE model = 'm-large'"""


def digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = responses.merge_summaries(lineup(spark, sf), _summaries(spark, sf))
    entries = responses.digest_entries(rows, 10, 200)
    total = responses.digest_tokens(entries)
    return entries.join(total, "run_id").select(
        "run_id", F.col("entry").cast("bigint").alias("entry"), "title", "body", F.col("tokens").cast("bigint").alias("tokens")
    )


DIGESTS_SQL = f"""WITH {LINEUP_SQL}, {_SUMMARIES_SQL},
e AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY section_pos, rank_in_section) AS entry, left(title, 200) AS title,
  left(coalesce(summary, excerpt), 200) AS body FROM lineup LEFT JOIN summaries ON doc = doc_id),
f AS (SELECT * FROM e WHERE entry <= 10)
SELECT *, CAST(sum({_sql_tokens('title')} + {_sql_tokens('body')} + 2) OVER (PARTITION BY run_id) AS BIGINT) AS tokens FROM f"""


AUDIENCES = [
    {"id": "mail", "channel": "email", "sections": ["*"], "format": "markdown", "detail": None},
    {"id": "phone", "channel": "wecom", "sections": ["notes", "lead"], "format": "text", "detail": None},
    {"id": "tablet", "channel": "telegram", "sections": ["lead", "notes"], "format": "text", "detail": None},
    {"id": "desk", "channel": "wecom", "sections": ["lead", "notes"], "format": "markdown", "detail": "full"},
]


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    items = responses.merge_summaries(lineup(spark, sf), _summaries(spark, sf)).withColumns(
        {
            "url": F.concat(F.lit("https://www.site.example/"), F.col("id")),
            "score": F.when(F.col("id").cast("int") % 2 == 0, F.col("id").cast("double")),
            "section_title": F.concat(F.lit("The "), F.col("section")),
            "takeaways": F.transform("takeaways", lambda t: F.trim(t)),
        }
    )
    day = F.lit("2024-01-31")
    number = F.substr("run_id", F.lit(5)).cast("int")
    issues = lineup(spark, sf).select("run_id").distinct().withColumns(
        {
            "title": F.lit("Daily *news*"),
            "date": day,
            "schedule_id": F.when(number % 2 == 0, "weekly").otherwise("daily"),
            "timezone": F.lit("UTC"),
            "digest": F.when(number % 3 != 0, F.concat(F.lit("digest_of "), F.col("run_id"))),
            "warnings": F.when(number % 4 == 0, F.array(F.lit("one_two"), F.lit("three"))),
        }
    )
    signed = documents.signatures(AUDIENCES, SECTION_IDS)
    return documents.document_blocks(issues, items, signed)


def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select(
        "run_id",
        "signature",
        F.col("ord.a").cast("bigint").alias("part"),
        F.col("ord.b").cast("bigint").alias("section_pos"),
        F.col("ord.c").cast("bigint").alias("place"),
        "block",
    )


def _esc(x: str) -> str:
    return rf"regexp_replace({x}, '([\\`*_\[\]<>])', '\\\1', 'g')"


_BLOCKS_SQL = f"""{LINEUP_SQL}, {_SUMMARIES_SQL},
kinds(signature, chosen, format, detail) AS (VALUES ('*|markdown|full', ['lead', 'notes', 'rest'], 'markdown', 'full'),
  ('lead,notes|text|compact', ['lead', 'notes'], 'text', 'compact'), ('lead,notes|markdown|full', ['lead', 'notes'], 'markdown', 'full')),
nums AS (SELECT DISTINCT run_id, CAST(substr(run_id, 5) AS INTEGER) AS n FROM lineup),
it AS (SELECT l.*, k.signature, k.format, k.detail, coalesce(summary, excerpt) AS whole,
   CASE WHEN doc % 4 = 3 THEN list_transform(string_split(summary, chr(10)), lambda x: trim(x)) ELSE [] END AS takes
  FROM lineup l LEFT JOIN summaries ON doc = doc_id JOIN (SELECT signature, format, detail, unnest(chosen) AS sec FROM kinds) k ON k.sec = l.section),
ib AS (SELECT *, CASE WHEN detail = 'compact' THEN {sql_truncate('whole', 100)} ELSE whole END AS body FROM it),
blocks AS (
  SELECT run_id, signature, 0 AS part, 0 AS section_pos, 0 AS place, CASE WHEN format = 'text' THEN '' ELSE '# ' END || 'Daily *news* · 2024-01-31' AS block FROM nums, kinds
  UNION ALL SELECT run_id, signature, 1, 0, 0, CASE WHEN format = 'text' THEN '【' || lab || '】' || chr(10) || 'digest_of ' || run_id
     ELSE '> **' || lab || '**' || chr(10) || '> ' || {_esc("'digest_of ' || run_id")} END
   FROM (SELECT *, CASE WHEN n % 2 = 0 THEN '本周导读' ELSE '今日导读' END AS lab FROM nums, kinds) WHERE n % 3 <> 0
  UNION ALL SELECT run_id, signature, 4, 0, 0, CASE WHEN format = 'text' THEN '抓取告警：' || chr(10) || '- one_two' || chr(10) || '- three'
     ELSE '> 抓取告警' || chr(10) || '> - one\\_two' || chr(10) || '> - three' END FROM nums, kinds WHERE n % 4 = 0
  UNION ALL SELECT run_id, signature, 5, 0, 0, '—— Daily *news* · ' || CASE WHEN n % 2 = 0 THEN 'weekly' ELSE 'daily' END || ' · UTC' FROM nums, kinds WHERE format <> 'text'
  UNION ALL SELECT run_id, signature, 2, section_pos, 0, CASE WHEN format = 'text' THEN '【The ' || section || '】' ELSE '## The ' || section END FROM ib WHERE rank_in_section = 0
  UNION ALL SELECT run_id, signature, 2, section_pos, rank_in_section + 1, CASE WHEN format = 'text' THEN
      (rank_in_section + 1) || '. ' || title || chr(10) || '   https://www.site.example/' || id || CASE WHEN body = '' THEN '' ELSE chr(10) || '   ' || body END
    ELSE (rank_in_section + 1) || '. [' || {_esc('title')} || '](https://www.site.example/' || id || ')' || chr(10) || '   '
      || {_esc("source || ' · site.example' || CASE WHEN doc_id % 2 = 0 AND doc_id > 0 THEN ' · ' || doc_id ELSE '' END")}
      || CASE WHEN body = '' THEN '' ELSE chr(10) || '   ' || {_esc('body')} END
      || array_to_string(list_transform(takes, lambda x: chr(10) || '   - ' || {_esc('x')}), '') END FROM ib)"""
BLOCKS_SQL = f"WITH {_BLOCKS_SQL} SELECT run_id, signature, part, section_pos, place, block FROM blocks"


def audience_documents(spark: SparkSession, sf: str) -> DataFrame:
    signed = documents.signatures(AUDIENCES, SECTION_IDS)
    docs = documents.assemble(_blocks(spark, sf))
    return documents.audience_documents(docs, signed).select("run_id", "audience", "body")


AUDIENCE_SQL = f"""WITH {_BLOCKS_SQL}, d AS (SELECT run_id, signature, string_agg(block, chr(10) || chr(10) ORDER BY part, section_pos, place) || chr(10) AS body FROM blocks GROUP BY 1, 2),
a(audience, signature) AS (VALUES ('mail', '*|markdown|full'), ('phone', 'lead,notes|text|compact'), ('tablet', 'lead,notes|text|compact'), ('desk', 'lead,notes|markdown|full'))
SELECT run_id, audience, body FROM d JOIN a ON a.signature = d.signature"""


def packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents")
    chunks = documents.pack_blocks(F.split("text", "\n"), 400, "chars")
    return docs.select("doc_id", F.posexplode(chunks).alias("n", "chunk")).withColumn("n", F.col("n").cast("bigint"))


PACKED_SQL = """WITH RECURSIVE b AS (SELECT doc_id, string_split(text, chr(10)) AS blocks FROM documents),
walk AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS chunks, NULL::VARCHAR AS cur FROM b
  UNION ALL SELECT w.doc_id, w.i + 1,
    CASE WHEN x = '' THEN w.chunks
      WHEN length(x) > 400 THEN list_concat(CASE WHEN w.cur IS NULL THEN w.chunks ELSE list_append(w.chunks, w.cur) END,
        list_transform(range(0, (length(x) + 399) // 400), lambda k: substr(x, k * 400 + 1, 400)))
      WHEN w.cur IS NOT NULL AND length(w.cur) + 2 + length(x) > 400 THEN list_append(w.chunks, w.cur) ELSE w.chunks END,
    CASE WHEN x = '' THEN w.cur WHEN length(x) > 400 THEN NULL
      WHEN w.cur IS NOT NULL AND length(w.cur) + 2 + length(x) <= 400 THEN w.cur || chr(10) || chr(10) || x ELSE x END
  FROM walk w JOIN b ON b.doc_id = w.doc_id, LATERAL (SELECT b.blocks[w.i + 1] AS x) WHERE w.i < len(b.blocks)),
f AS (SELECT w.doc_id, CASE WHEN cur IS NULL THEN chunks ELSE list_append(chunks, cur) END AS chunks
  FROM walk w JOIN b ON b.doc_id = w.doc_id WHERE w.i = len(b.blocks))
SELECT doc_id, unnest(range(0, len(chunks))) AS n, unnest(chunks) AS chunk FROM f"""


def packed_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-bounded chunks, checked by their sizes and by losing no character."""
    docs = tables.table(spark, sf, "documents")
    chunks = documents.pack_blocks(documents.paragraphs(F.col("text")), 4096, "bytes")
    letters = F.length(F.regexp_replace(F.array_join("chunks", ""), r"\s", ""))
    return docs.withColumn("chunks", chunks).select(
        "doc_id",
        F.forall("chunks", lambda c: F.octet_length(c) <= 4096).alias("fits"),
        letters.cast("bigint").alias("letters"),
    )


PACKED_BYTES_SQL = r"SELECT doc_id, true AS fits, length(regexp_replace(text, '\s', '', 'g')) AS letters FROM documents"



def packed_byte_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of at most 4096 bytes, of lines; longer lines are cut between characters."""
    docs = tables.table(spark, sf, "documents")
    chunks = documents.pack_blocks(F.split("text", "\n"), 4096, "bytes")
    return docs.select("doc_id", F.posexplode(chunks).alias("n", "chunk")).withColumn("n", F.col("n").cast("bigint"))


PACKED_CHUNKS_SQL = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, unnest(regexp_extract_all(x, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(x, '(?s).'), 1) AS i FROM l WHERE strlen(x) > 4096),
u AS (SELECT doc_id, pos, list(ch ORDER BY i) AS chars, list(e ORDER BY i) AS ends
  FROM (SELECT *, sum(strlen(ch)) OVER (PARTITION BY doc_id, pos ORDER BY i) AS e FROM c) GROUP BY doc_id, pos),
cut AS (SELECT doc_id, pos, 0::BIGINT AS a, len(list_filter(ends, lambda e: e <= 4096)) AS b FROM u
  UNION ALL SELECT cut.doc_id, cut.pos, cut.b, len(list_filter(u.ends, lambda e: e <= u.ends[cut.b] + 4096))
  FROM cut JOIN u ON u.doc_id = cut.doc_id AND u.pos = cut.pos WHERE cut.b < len(u.chars)),
pieces AS (SELECT cut.doc_id, cut.pos, a, array_to_string(chars[a + 1 : b], '') AS x, false AS whole FROM cut JOIN u ON u.doc_id = cut.doc_id AND u.pos = cut.pos
  UNION ALL SELECT doc_id, pos, 0, x, true FROM l WHERE strlen(x) BETWEEN 1 AND 4096),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, a) AS i FROM pieces),
walk AS (SELECT doc_id, i, 0::BIGINT AS n, CASE WHEN whole THEN strlen(x) ELSE -1 END AS size FROM p WHERE i = 1
  UNION ALL SELECT doc_id, i, CASE WHEN fits THEN n ELSE n + 1 END, CASE WHEN fits THEN size + 2 + strlen(x) WHEN whole THEN strlen(x) ELSE -1 END
  FROM (SELECT p.*, w.n, w.size, p.whole AND w.size >= 0 AND w.size + 2 + strlen(p.x) <= 4096 AS fits FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1))
SELECT p.doc_id, walk.n, string_agg(p.x, chr(10) || chr(10) ORDER BY p.i) AS chunk FROM p JOIN walk ON walk.doc_id = p.doc_id AND walk.i = p.i GROUP BY p.doc_id, walk.n"""

LANDED_AT = "2024-02-01 00:00:00"
PER_BODY = 10


def _xml(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _landing(spark: SparkSession, sf: str, entry: Column, wrap) -> DataFrame:
    """Ten documents per landed body; every seventh body is cut off, every eleventh a 503."""
    body_no = F.floor(F.col("doc_id") / PER_BODY)
    grouped = (
        tables.table(spark, sf, "documents")
        .withColumn("body_no", body_no)
        .withColumn("entry", entry)
        .groupBy("body_no")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda r: r["entry"]).alias("entries"))
    )
    whole = wrap(F.col("entries"))
    cut = F.substring(whole, 1, 60)
    return grouped.select(
        F.lit("r").alias("run_id"),
        F.concat(F.lit("source-"), F.col("body_no").cast("string")).alias("source"),
        F.lit(LANDED_AT).cast("timestamp").alias("fetched_at"),
        F.when(F.col("body_no") % 11 == 5, 503).otherwise(200).alias("status"),
        F.when(F.col("body_no") % 7 == 3, cut).otherwise(whole).alias("body"),
    )


def shown(parsed: tuple[DataFrame, DataFrame]) -> DataFrame:
    items, errors = parsed
    rows = items.select("source", F.col("item_pos").cast("bigint").alias("item_pos"), "title", "url", "published", "score", "excerpt", F.lit(None).cast("string").alias("error"))
    bad = errors.select("source", *[F.lit(None).cast(t).alias(n) for n, t in (("item_pos", "bigint"), ("title", "string"), ("url", "string"), ("published", "string"), ("score", "double"), ("excerpt", "string"))], "error")
    return rows.unionByName(bad)


def feed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Odd bodies are Atom, even ones RSS."""
    number = F.col("doc_id").cast("string")
    rss = F.concat(
        F.lit("<item><title>t"), number, F.lit("</title><link>https://x.example/"), number,
        F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>"), _xml(F.col("text")), F.lit("</description></item>"),
    )
    atom = F.concat(
        F.lit('<entry><title type="html">t'), number, F.lit('</title><link rel="edit" href="https://e.example/"/><link rel="alternate" href="https://x.example/'), number,
        F.lit('"/><updated>2024-01-01T10:00:00Z</updated><summary>'), _xml(F.col("text")), F.lit("</summary></entry>"),
    )
    odd = F.floor(F.col("doc_id") / PER_BODY) % 2 == 1
    is_atom = F.col("body_no") % 2 == 1

    def wrap(entries: Column) -> Column:
        inside = F.array_join(entries, "")
        return F.when(is_atom, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), inside, F.lit("</feed>"))).otherwise(
            F.concat(F.lit('<rss version="2.0"><channel><title>c</title>'), inside, F.lit("</channel></rss>"))
        )

    return _landing(spark, sf, F.when(odd, atom).otherwise(rss), wrap)


def feed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return shown(feeds.parse_feeds(feed_bodies(spark, sf)))


def landed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of each landed source with the errors that statuses and the parser gave."""
    landing = materialize(feed_bodies(spark, sf), "bodies")
    entries, errors = feeds.parse_feeds(landing)
    items = entries.withColumn("published_at", published_at(F.col("published"), F.col("run_time")))
    outcomes = source_outcomes(landing.select("run_id", "source"), items, errors)
    latest = F.date_format("latest_published_at", "yyyy-MM-dd HH:mm:ss").alias("latest")
    return outcomes.select("source", "n_items", latest, "error")


LANDED_OUTCOMES_SQL = f"""WITH d AS (SELECT doc_id // {PER_BODY} AS body_no, count(*) AS n FROM documents GROUP BY 1),
e AS (SELECT *, CASE WHEN body_no % 11 = 5 THEN 'HTTP 503' WHEN body_no % 7 = 3 THEN 'body could not be parsed' END AS error FROM d)
SELECT 'source-' || body_no AS source, CASE WHEN error IS NULL THEN n ELSE 0 END AS n_items,
  CASE WHEN error IS NULL THEN '2024-01-01 10:00:00' END AS latest, error FROM e"""


def _payload_sql(title: str, url: str, published: str, score: str, excerpt: str) -> str:
    return rf"""WITH d AS (SELECT *, doc_id // {PER_BODY} AS body_no, doc_id % {PER_BODY} AS item_pos FROM documents)
SELECT 'source-' || body_no AS source, item_pos, {title} AS title, {url} AS url, {published} AS published, {score} AS score, {excerpt} AS excerpt, NULL AS error
FROM d WHERE body_no % 11 <> 5 AND body_no % 7 <> 3
UNION ALL SELECT DISTINCT 'source-' || body_no, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN body_no % 11 = 5 THEN 'HTTP 503' ELSE 'body could not be parsed' END FROM d WHERE body_no % 11 = 5 OR body_no % 7 = 3"""


FEED_SQL = _payload_sql(
    "'t' || doc_id",
    "'https://x.example/' || doc_id",
    "CASE WHEN body_no % 2 = 1 THEN '2024-01-01T10:00:00Z' ELSE 'Mon, 01 Jan 2024 10:00:00 GMT' END",
    "NULL::DOUBLE",
    r"regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')",
)


def story_payloads(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    entry = F.struct(
        number.cast("string").alias("objectID"),
        F.when(number % 2 == 0, F.col("text")).alias("title"),
        F.lit("told").alias("story_title"),
        F.when(number % 3 == 0, F.concat(F.lit("https://x.example/"), number.cast("string"))).alias("url"),
        F.when(number % 5 != 0, number.cast("int")).alias("points"),
        F.lit("2024-01-01T10:00:00Z").alias("created_at"),
        F.lit(7).alias("num_comments"),
    )
    return shown(
        feeds.parse_stories(_landing(spark, sf, entry, lambda e: F.to_json(F.struct(e.alias("hits")))))
    )


STORY_SQL = _payload_sql(
    "CASE WHEN doc_id % 2 = 0 THEN text ELSE 'told' END",
    "CASE WHEN doc_id % 3 = 0 THEN 'https://x.example/' || doc_id ELSE 'https://news.ycombinator.com/item?id=' || doc_id END",
    "'2024-01-01T10:00:00Z'",
    "CASE WHEN doc_id % 5 <> 0 THEN doc_id::DOUBLE ELSE 0.0::DOUBLE END",
    "CASE WHEN doc_id % 5 <> 0 THEN doc_id ELSE 0 END || ' points · 7 comments · https://news.ycombinator.com/item?id=' || doc_id",
)


def repository_payloads(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    entry = F.struct(
        F.concat(F.col("source"), F.lit("/"), number.cast("string")).alias("full_name"),
        F.concat(F.lit("https://x.example/"), number.cast("string")).alias("html_url"),
        F.when(number % 2 == 0, F.col("text")).alias("description"),
        number.cast("int").alias("stargazers_count"),
        F.lit("2024-01-01T10:00:00Z").alias("created_at"),
        F.when(number % 3 == 0, F.col("lang")).alias("language"),
    )
    return shown(
        feeds.parse_repositories(_landing(spark, sf, entry, lambda e: F.to_json(F.struct(e.alias("items")))))
    )


REPOSITORY_SQL = _payload_sql(
    "source || '/' || doc_id",
    "'https://x.example/' || doc_id",
    "'2024-01-01T10:00:00Z'",
    "doc_id::DOUBLE",
    "CASE WHEN doc_id % 2 = 0 THEN text ELSE '(no description)' END || ' — ★' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' · ' || lang ELSE '' END",
)


def size_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Page bodies against a cap that some of them exceed."""
    landed = tables.table(spark, sf, "pages").select(
        "page_id", F.lit(200).alias("status"), F.col("html").alias("body")
    )
    return feeds.with_landing_error(landed, 6000).select("page_id", "error")


GUARD_SQL = """SELECT page_id, CASE WHEN length(html) > 6000 THEN 'response too large: ' || length(html) || ' chars > 6000' END AS error FROM pages"""

QUERIES = {
    "summary_policy": (policies, POLICIES_SQL),
    "quality_gate": (gate, GATE_SQL),
    "turn_order": (turns, TURNS_SQL),
    "budget_allocation": (budget, BUDGET_SQL),
    "request_table": (requests, REQUESTS_SQL),
    "summary_merge": (merged, MERGED_SQL),
    "summary_versions": (versions, VERSIONS_SQL),
    "digest_input": (digests, DIGESTS_SQL),
    "document_blocks": (document_blocks, BLOCKS_SQL),
    "audience_documents": (audience_documents, AUDIENCE_SQL),
    "pack_chunks": (packed, PACKED_SQL),
    "pack_bytes": (packed_bytes, PACKED_BYTES_SQL),
    "pack_byte_chunks": (packed_byte_chunks, PACKED_CHUNKS_SQL),
    "feed_payloads": (feed_payloads, FEED_SQL),
    "landed_outcomes": (landed_outcomes, LANDED_OUTCOMES_SQL),
    "story_payloads": (story_payloads, STORY_SQL),
    "repository_payloads": (repository_payloads, REPOSITORY_SQL),
    "payload_size_guard": (size_guard, GUARD_SQL),
}
