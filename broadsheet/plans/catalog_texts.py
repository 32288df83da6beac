"""Registered queries on texts, URLs and pages, each with equivalent ANSI SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import redact as rd
from broadsheet.functions import text as tx
from broadsheet.functions import times as tm
from broadsheet.functions import urls as ur
from broadsheet.operators import extraction, normalize, responses
from broadsheet.sources import tables
from broadsheet.session import dimension, let
from pyspark.sql import types as T

# The same white space class for the SQL engine's regular expressions.
SQL_SPACE = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

DOCS_SQL = r"""
docs AS (
  SELECT substr(sha256(text), 1, 16) AS id, trim(regexp_extract(text, '^[^.!?\n]*')) AS title,
         source, text AS excerpt, lang, doc_id AS item_pos
  FROM documents)"""

#: Boilerplate patterns per source, used by the document queries.
PATTERNS = [
    {"source": "src0", "strip_patterns": ["the", r"\bof\b"]},
    {"source": "src1", "strip_patterns": ["^[a-z]+ "]},
    {"source": "src2", "strip_patterns": ["and", "an", "e+"]},
]
_PATTERN_TYPE = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("strip_patterns", T.ArrayType(T.StringType()))]
)


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SQL_SPACE}]+', ' ', 'g'))"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')"


def sql_entities(x: str) -> str:
    """Named and numeric references through a lookup of the split text."""
    keys = ", ".join("'" + k.replace("'", "''") + "'" for k in tx.ENTITIES)
    values = ", ".join("'" + v.replace("'", "''") + "'" for v in tx.ENTITIES.values())
    ref = r"(?i)&(#x?[0-9a-f]+|[a-z]+);"
    table = f"map([{keys}], [{values}])"
    return (
        "list_reduce(list_concat([''], list_transform("
        f"list_zip(string_split_regex({x}, '{ref}'), list_concat(regexp_extract_all({x}, '{ref}'), [''])),"
        f" lambda p: p[1] || CASE WHEN p[2] = '' THEN '' ELSE coalesce({table}[p[2][2:-2]],"
        f" {table}[lower(p[2][2:-2])],"
        " CASE WHEN regexp_matches(p[2], '^&#[0-9]+;$') THEN chr(CAST(p[2][3:-2] AS INTEGER)) END,"
        " p[2]) END)), lambda a, b: a || b)"
    )


def sql_strip_html(x: str) -> str:
    return sql_collapse(sql_entities(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


def sql_strip_boilerplate(x: str, source: str) -> str:
    cases = ""
    for row in PATTERNS:
        inner = x
        for p in row["strip_patterns"]:
            inner = f"regexp_replace({inner}, '(?i){p}', ' ', 'g')"
        cases += f" WHEN {source} = '{row['source']}' THEN {inner}"
    return sql_collapse(f"CASE{cases} ELSE {x} END")


def sql_truncate(x: str, limit: int) -> str:
    """The truncation rule over character positions."""
    floor = -(-limit // 2)
    closers = "[" + tx.CLOSERS.replace("]", r"\]").replace("'", "''") + "]*"
    end = f"i + length(regexp_extract(substr({x}, i + 1, {limit} + 1), '^{closers}'))"
    wide = f"contains('{tx.WIDE_ENDERS}', substr({x}, i, 1))"
    narrow = f"contains('{tx.NARROW_ENDERS}', substr({x}, i, 1))"
    before = f"substr({x}, 1, i - 1)"
    cut = f"""list_max(list_concat([0], list_transform(list_filter(range(1, {limit} + 1),
      lambda i: ({wide} OR ({narrow}
        AND regexp_matches(substr({x}, {end} + 1, 1), '^[{SQL_SPACE}]')
        AND regexp_matches({before}, '[\\p{{L}}\\p{{N}}]{{2}}$')
        AND NOT regexp_matches({before}, '\\.[\\p{{L}}\\p{{N}}]+$')))
        AND {end} <= {limit}), lambda i: {end})))"""
    head = f"substr({x}, 1, {limit - 1})"
    space = f"length(regexp_extract({head}, '^(?s)(.*) [^ ]*$', 1))"
    at_word = f"CASE WHEN contains({head}, ' ') AND {space} >= {floor} THEN substr({x}, 1, {space}) ELSE {head} END"
    rtrim = f"regexp_replace({at_word}, '[{SQL_SPACE}]+$', '') || '…'"
    return (
        f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN {cut} >= {floor}"
        f" THEN {sql_trim(f'substr({x}, 1, {cut})')} ELSE {rtrim} END"
    )


def sql_title_key(x: str) -> str:
    # The given texts hold no compatibility characters, so composing is enough here.
    return sql_collapse(rf"regexp_replace(nfc_normalize(lower({x})), '[\p{{P}}\p{{S}}]', ' ', 'g')")


def sql_numbers(x: str) -> str:
    return rf"list_aggregate(list_sort(regexp_extract_all({x}, '\d+')), 'string_agg', ',')"


_URL_PARTS = r"""
u AS (
  SELECT page_id, url, regexp_extract(url, '^(?i)https?://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS p
  FROM pages),
q AS (
  SELECT page_id, url, lower(p.host) AS host, p.path AS path,
    list_sort(list_filter(list_filter(string_split(substr(p.query, 2), '&'), lambda x: x <> ''),
      lambda x: NOT regexp_matches(split_part(x, '=', 1),
        '^(?i)(utm_.*|ref|ref_.*|fbclid|gclid|mc_cid|mc_eid|igshid|source|__twitter_impression|spm)$'))) AS params
  FROM u),
c AS (
  SELECT page_id, url, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
  FROM q)"""


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return tables.table(spark, sf, "pages").select(
        "page_id",
        ur.canonical_url(url).alias("canonical"),
        ur.item_id(url).alias("item_id"),
        ur.host_name(url).alias("host"),
    )


CANONICAL_SQL = f"""WITH {_URL_PARTS}
SELECT page_id, canonical, substr(sha256(canonical), 1, 16) AS item_id,
  regexp_extract(canonical, '^[^/?]*') AS host FROM c"""


def fetchable_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The predicate over every page URL and over addresses derived from page ids."""
    pages = tables.table(spark, sf, "pages")

    def octet(shift: int) -> Column:
        return F.pmod(F.floor(F.col("page_id") * 2654435761 / shift), F.lit(256))

    dotted = F.concat_ws(".", *[octet(s).cast("string") for s in (1, 256, 65536, 16777216)])
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("http://"), dotted, F.lit("/x")),
        F.concat(F.lit("https://user:pw@"), F.substring_index("url", "//", -1)),
        F.concat(F.lit("ftp:"), F.substring_index("url", ":", -1)),
        F.concat(F.lit("http://h"), F.col("page_id").cast("string"), F.lit(".internal/")),
    )
    return pages.select("page_id", F.posexplode(forms).alias("form", "url")).select(
        "page_id", "form", ur.is_fetchable(F.col("url")).alias("fetchable")
    )


FETCHABLE_SQL = """
WITH o AS (SELECT page_id,
    CAST(floor(page_id * 2654435761 / 1) % 256 AS INTEGER) a,
    CAST(floor(page_id * 2654435761 / 256) % 256 AS INTEGER) b FROM pages)
SELECT page_id, 0 AS form, true AS fetchable FROM pages
UNION ALL SELECT page_id, 1, NOT (a IN (0, 10, 127) OR (a = 169 AND b = 254)
   OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168))
   OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224) FROM o
UNION ALL SELECT page_id, f, false FROM pages, (VALUES (2), (3), (4)) t(f)"""


def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    title = F.col("title")
    return tables.document_items(spark, sf).select(
        F.col("item_pos").alias("doc_id"),
        tx.title_key(title).alias("title_key"),
        tx.title_numbers(F.col("excerpt")).alias("numbers"),
        F.size(tx.key_grams(tx.title_key(title))).alias("n_grams"),
    )


TITLE_KEYS_SQL = f"""WITH {DOCS_SQL}, k AS (
  SELECT item_pos, excerpt, {sql_title_key('title')} AS title_key FROM docs),
s AS (SELECT *, regexp_replace(title_key, '[{SQL_SPACE}]+', '', 'g') AS joined FROM k)
SELECT item_pos AS doc_id, title_key, coalesce({sql_numbers('excerpt')}, '') AS numbers,
  CAST(len(list_distinct(list_transform(range(1, greatest(length(joined) - 2, 1)), lambda i: substr(joined, i, 4)))) AS INTEGER) AS n_grams
FROM s"""


def plain_pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select(
        "page_id", tx.strip_html(F.col("html")).alias("plain")
    )


PLAIN_PAGES_SQL = f"SELECT page_id, {sql_strip_html('html')} AS plain FROM pages"


def decoded_pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select(
        "page_id", tx.decode_entities(F.col("html")).alias("decoded")
    )


DECODED_SQL = f"SELECT page_id, {sql_entities('html')} AS decoded FROM pages"


def _patterns(spark: SparkSession) -> DataFrame:
    return dimension(spark, PATTERNS, _PATTERN_TYPE)


def boilerplate_free(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.document_items(spark, sf).join(_patterns(spark), "source", "left")
    return docs.select(
        F.col("item_pos").alias("doc_id"),
        tx.strip_boilerplate(F.col("title"), F.col("strip_patterns")).alias("title"),
        tx.strip_boilerplate(F.col("excerpt"), F.col("strip_patterns")).alias("text"),
    )


BOILERPLATE_SQL = f"""WITH {DOCS_SQL}
SELECT item_pos AS doc_id, {sql_strip_boilerplate('title', 'source')} AS title,
  {sql_strip_boilerplate('excerpt', 'source')} AS text FROM docs"""


def truncated(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.document_items(spark, sf)
    cuts = let(
        tx.collapse_space(F.col("excerpt")),
        lambda t: F.struct(tx.truncate(t, 300).alias("cut_300"), tx.truncate(t, 100).alias("cut_100")),
    )
    return docs.select(F.col("item_pos").alias("doc_id"), cuts.alias("cuts")).select("doc_id", "cuts.*")


TRUNCATED_SQL = f"""WITH t AS (SELECT doc_id, {sql_collapse('text')} AS t FROM documents)
SELECT doc_id, {sql_truncate('t', 300)} AS cut_300, {sql_truncate('t', 100)} AS cut_100 FROM t"""


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.document_items(spark, sf).join(_patterns(spark), "source", "left")
    return docs.select(
        F.col("item_pos").alias("doc_id"),
        tx.excerpt(F.col("excerpt"), F.col("strip_patterns")).alias("excerpt"),
    )


EXCERPTS_SQL = f"""WITH {DOCS_SQL}, p AS (
  SELECT item_pos, {sql_strip_boilerplate(sql_strip_html('excerpt'), 'source')} AS t FROM docs)
SELECT item_pos AS doc_id, nullif({sql_truncate('t', 300)}, '') AS excerpt FROM p"""


def normalized_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as raw entries: the page title, the url, the whole page as description."""
    entries = tables.table(spark, sf, "pages").select(
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        "url",
        F.lit("pages").alias("source"),
        F.when(F.col("page_id") % 3 == 0, F.lit("2024-01-15T10:00:00Z")).alias("published"),
        F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("double")).alias("score"),
        F.when(F.col("page_id") % 5 == 0, F.lit("  ")).otherwise(F.lit(" Ann ")).alias("author"),
        F.col("html").alias("excerpt"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("run_time"),
    )
    return normalize.normalize(entries).withColumn(
        "published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")
    )


NORMALIZED_SQL = rf"""WITH {_URL_PARTS},
r AS (SELECT pages.page_id, pages.url, canonical, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, html
  FROM pages JOIN c ON c.page_id = pages.page_id),
t AS (SELECT *, {sql_strip_html('title')} AS clean, {sql_strip_html('html')} AS plain FROM r)
SELECT substr(sha256(canonical), 1, 16) AS id, clean AS title, {sql_trim('url')} AS url, 'pages' AS source,
  CASE WHEN page_id % 3 = 0 THEN '2024-01-15 10:00:00' ELSE '2024-02-01 00:00:00' END AS published_at,
  CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS DOUBLE) END AS score,
  CASE WHEN page_id % 5 <> 0 THEN 'Ann' END AS author,
  nullif({sql_truncate('plain', 300)}, '') AS excerpt
FROM t WHERE clean <> ''"""


def publish_times(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in several spellings and read back."""
    ev = tables.table(spark, sf, "events")
    run = F.lit("2024-02-01 00:00:00").cast("timestamp")
    form = F.col("event_id") % 5
    text = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(form == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(form == 3, F.lit("soon"))
    )
    seconds = F.unix_seconds("ts").cast("double")
    number = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(seconds * 1000)
    shown = "yyyy-MM-dd HH:mm:ss"
    return ev.select(
        "event_id",
        F.date_format(tm.published_at(text, run), shown).alias("from_text"),
        F.date_format(tm.published_at_epoch(number, run), shown).alias("from_number"),
    )


PUBLISH_SQL = """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN event_id % 5 = 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE '2024-02-01 00:00:00' END AS from_text,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_number FROM events"""


def local_dates(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.lit("Asia/Shanghai")
    return (
        tables.table(spark, sf, "events")
        .groupBy(tm.local_date(F.col("ts"), zone).alias("local_date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(tm.local_time(F.col("ts"), zone)).alias("first_time"),
        )
    )


LOCAL_DATES_SQL = """SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_date, count(*) AS n,
  min(strftime(ts + INTERVAL 8 HOUR, '%H:%M')) AS first_time FROM events GROUP BY 1"""


def languages_and_tokens(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return tables.table(spark, sf, "documents").select(
        "doc_id",
        tx.title_language(text).alias("language"),
        tx.token_estimate(text).cast("bigint").alias("tokens"),
    )


LANGUAGE_SQL = r"""SELECT doc_id,
  CASE WHEN letters > 0 AND han / letters >= 0.3 THEN 'zh' ELSE 'other' END AS language,
  CAST(ceil(cjk + (n - cjk) / 4) AS BIGINT) AS tokens
FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '\p{L}')) AS letters,
  len(regexp_extract_all(text, '\p{Han}')) AS han,
  len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS cjk FROM documents)"""


def article_texts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select(
        "page_id", extraction.html_to_text(F.col("html")).alias("article")
    )


def _sql_article() -> str:
    clean = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    clean = rf"regexp_replace({clean}, '(?i)<(?:{extraction.SELF_CLOSING})\b[^>]*/>', ' ', 'g')"
    # No back-references here; these pages nest no chrome, so one tag at a time is equal.
    for tag in extraction.CHROME.split("|"):
        clean = rf"regexp_replace({clean}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    region = r"regexp_extract_all(clean, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)"
    marked = r"regexp_replace(region, '(?i)<a\b[^>]*>', chr(57344), 'g')"
    marked = rf"regexp_replace({marked}, '(?i)</a\s*>', chr(57345), 'g')"
    marked = rf"regexp_replace({marked}, '(?i)</?(?:{extraction.BLOCKS})\b[^>]*>', chr(10), 'g')"
    marked = f"regexp_replace({marked}, '<[^>]*>', ' ', 'g')"

    def squeeze(x: str) -> str:
        return sql_trim(f"regexp_replace({x}, ' {{2,}}', ' ', 'g')")

    blanks = rf"[\x{{e000}}\x{{e001}}{SQL_SPACE}]"
    linked = (
        rf"length(regexp_replace(array_to_string(regexp_extract_all(x, '\x{{e000}}[^\x{{e001}}]*'), ''), '{blanks}', '', 'g'))"
    )
    total = f"length(regexp_replace(x, '{blanks}', '', 'g'))"
    spaced = r"regexp_replace(x, '[\t\r\x{00a0}]', ' ', 'g')"
    bare = r"regexp_replace(x, '[\x{e000}\x{e001}]', '', 'g')"
    return rf"""WITH a AS (SELECT page_id, {clean} AS clean FROM pages),
b AS (SELECT page_id, clean, list_sort(list_filter(list_transform({region}, lambda t, i: {{'n': length(t), 'i': -i, 't': t}}), lambda s: s.n > 200), 'DESC') AS found FROM a),
r AS (SELECT page_id, CASE WHEN len(found) > 0 THEN found[1].t
  ELSE coalesce(nullif(regexp_extract(clean, '(?is)<body\b[^>]*>(.*?)</body\s*>', 1), ''), clean) END AS region FROM b),
m AS (SELECT page_id, {marked} AS marked FROM r),
d AS (SELECT page_id, {sql_entities('marked')} AS decoded FROM m),
l AS (SELECT page_id, list_transform(string_split(decoded, chr(10)), lambda x: {squeeze(spaced)}) AS lines FROM d),
f AS (SELECT page_id, list_filter(lines, lambda x: NOT (contains(x, chr(57344)) AND ({total} = 0 OR {linked} / {total} > 0.6))) AS lines FROM l)
SELECT page_id, {sql_trim(f"array_to_string(list_filter(list_transform(lines, lambda x: {squeeze(bare)}), lambda x: length(x) >= 2), chr(10))")} AS article FROM f"""


def accepted_articles(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 7 == 0, "application/pdf")
        .when(F.col("page_id") % 13 == 0, F.lit(None))
        .otherwise("text/html; charset=utf-8")
        .alias("content_type"),
        "html",
    )
    return extraction.extract_articles(pages, max_html=20_000).select(
        "page_id", "input_kind", "reason", "article"
    )


ACCEPTED_SQL = f"""WITH art AS ({_sql_article()}), e AS (
  SELECT pages.page_id, article, length(article) AS n,
    CASE WHEN pages.page_id % 11 = 0 THEN 'HTTP 404'
      WHEN pages.page_id % 7 = 0 THEN 'not html (content-type: application/pdf)'
      WHEN pages.page_id % 13 = 0 THEN 'not html (content-type: none)'
      WHEN length(html) > 20000 THEN 'page too large: ' || length(html) || ' chars > 20000'
      WHEN length(article) < 200 THEN 'extracted only ' || length(article) || ' chars (< 200)' END AS reason
  FROM pages JOIN art ON art.page_id = pages.page_id)
SELECT page_id, CASE WHEN reason IS NULL THEN 'fulltext' ELSE 'excerpt' END AS input_kind, reason,
  CASE WHEN reason IS NULL THEN left(article, 6000) END AS article FROM e"""


def _with_secrets(text: Column, key: Column) -> Column:
    """Texts with secret shapes derived from their keys."""
    return F.concat(
        F.lit("see https://user:p"), key, F.lit("@h.example/x?token=t"), key,
        F.lit("&a=1 sk-abcdefghijkl"), key, F.lit(" ghp_0123456789abcdef"), key,
        F.lit(" https://api.telegram.org/bot"), key, F.lit(":k/send "), text,
    )


def redacted(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select(
        "doc_id",
        F.struct(
            _with_secrets(F.col("text"), F.col("doc_id").cast("string")).alias("note"),
            F.array(F.col("source"), F.concat(F.lit("key hunter22 "), F.col("lang"))).alias("tags"),
        ).alias("row"),
    )
    out = rd.redact_rows(docs, ["hunter22", "src1"])
    return out.select("doc_id", "row.note", F.array_join("row.tags", "|").alias("tags"))


REDACTED_SQL = r"""WITH n AS (SELECT doc_id, source, lang, replace(replace(
 'see https://user:p' || doc_id || '@h.example/x?token=t' || doc_id || '&a=1 sk-abcdefghijkl' || doc_id
 || ' ghp_0123456789abcdef' || doc_id || ' https://api.telegram.org/bot' || doc_id || ':k/send ' || text, 'hunter22', '[REDACTED]'), 'src1', '[REDACTED]') AS t FROM documents),
a AS (SELECT *, regexp_replace(t, '(?i)https?://qyapi\.weixin\.qq\.com/[^\s"'')]*', 'https://qyapi.weixin.qq.com/[REDACTED]', 'g') AS t1 FROM n),
b AS (SELECT *, regexp_replace(t1, '(?i)https?://api\.telegram\.org/bot[^/\s"'')]+', 'https://api.telegram.org/bot[REDACTED]', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '(?i)https?://sctapi\.ftqq\.com/[^\s"'')]*', 'https://sctapi.ftqq.com/[REDACTED]', 'g') AS t3 FROM b),
d AS (SELECT *, regexp_replace(t3, '(?i)([?&](?:key|token|sendkey|access_token|apikey|api_key)=)[^&\s"'')]+', '\1[REDACTED]', 'g') AS t4 FROM c),
e AS (SELECT *, regexp_replace(t4, '\bre_[A-Za-z0-9_-]{12,}', '[REDACTED]', 'g') AS t5 FROM d),
f AS (SELECT *, regexp_replace(t5, '\bsk-[A-Za-z0-9_-]{12,}', '[REDACTED]', 'g') AS t6 FROM e),
g AS (SELECT *, regexp_replace(t6, '\bgh[pousr]_[A-Za-z0-9]{16,}', '[REDACTED]', 'g') AS t7 FROM f)
SELECT doc_id, regexp_replace(t7, '(?i)(\b[a-z][a-z0-9+.-]*://)[^/\s:@"'']+:[^/\s@"'']+@', '\1[REDACTED]@', 'g') AS note,
 replace(source, 'src1', '[REDACTED]') || '|key [REDACTED] ' || lang AS tags FROM g"""


def sanitized(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns dressed with a label, links and markup, then cleaned whole."""
    turns = tables.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    raw = F.concat(
        F.lit("Summary: see [the docs](https://x.example/a) www.y.example/b <b>"),
        F.col("text"),
        F.lit("</b> and z.example/c\u200b end"),
    )
    return turns.select("conv_id", "turn", responses.sanitize_plain(raw).alias("clean"))


def sql_sanitize(x: str) -> str:
    out = rf"regexp_replace({x}, '(?i)^\s*```[a-z]*\s*|\s*```\s*$', ' ', 'g')"
    out = rf"regexp_replace({out}, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
    out = rf"regexp_replace({out}, '(?i)\b(?:[a-z][a-z0-9+.-]*://|www\.)\S+', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2,}}/\S*', ' ', 'g')"
    out = sql_strip_html(out)
    out = rf"regexp_replace({out}, '[\x00-\x1f\x7f]', ' ', 'g')"
    out = rf"regexp_replace({out}, '[\x{{200b}}-\x{{200f}}\x{{2028}}\x{{2029}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}\x{{feff}}]', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)^\s*(?:摘要|概括|总结|要点|summary|tl;?dr)\s*[:：、-]\s*', '')"
    return sql_collapse(out)


SANITIZED_SQL = f"""WITH r AS (SELECT conv_id, turn, 'Summary: see [the docs](https://x.example/a) www.y.example/b <b>'
  || text || '</b> and z.example/c' || chr(8203) || ' end' AS raw FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, {sql_sanitize('raw')} AS clean FROM r"""


def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as plain JSON, fenced JSON, JSON in prose, prose and arrays."""
    turns = tables.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    lines = F.split("text", "\n")
    body = F.to_json(F.struct(F.col("text").alias("summary"), lines.alias("takeaways")))
    blank = F.to_json(F.struct(F.lit("").alias("summary"), lines.alias("takeaways")))
    form = (F.col("conv_id") + F.col("turn")) % 5
    raw = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here you are: "), blank, F.lit(" done")))
        .when(form == 3, F.to_json(lines))
        .otherwise(F.col("text"))
    )
    parsed = responses.parse_responses(turns.select("conv_id", "turn", raw.alias("raw")), 100_000)
    return parsed.select(
        "conv_id", "turn", "summary", F.array_join("takeaways", "|").alias("takeaways")
    )


_CLEAN_LINE = sql_sanitize(r"regexp_replace(x, '^\s*(?:[-*•·]|\d+[.)、])\s*', '')")
PARSED_SQL = f"""WITH t AS (SELECT conv_id, turn, text, (conv_id + turn) % 5 AS form,
    string_split(text, chr(10)) AS lines,
    CASE WHEN (conv_id + turn) % 5 = 3 THEN CAST(to_json(string_split(text, chr(10))) AS VARCHAR) ELSE text END AS shown
  FROM conversations WHERE role = 'assistant'),
k AS (SELECT conv_id, turn, form, {sql_sanitize('shown')} AS clean,
  list_filter(list_transform(lines, lambda x: {_CLEAN_LINE}), lambda x: x <> '') AS all_lines FROM t),
d AS (SELECT *, list_filter(all_lines, lambda x, i: list_position(all_lines, x) = i)[1:3] AS takes FROM k)
SELECT conv_id, turn, CASE WHEN form = 2 THEN takes[1] ELSE nullif(clean, '') END AS summary,
  CASE WHEN form IN (0, 1) THEN array_to_string(takes, '|') WHEN form = 2 THEN array_to_string(takes[2:], '|')
    ELSE '' END AS takeaways FROM d"""


def parsed_digests(spark: SparkSession, sf: str) -> DataFrame:
    turns = tables.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    form = F.col("turn") % 3
    raw = (
        F.when(form == 0, F.to_json(F.struct(F.col("text").alias("digest"))))
        .when(form == 1, F.to_json(F.struct(F.col("text").alias("summary"), F.col("turn"))))
        .otherwise(F.col("text"))
    )
    return turns.select("conv_id", "turn", responses.parse_digest(raw, 100_000).alias("digest"))


DIGEST_SQL = f"SELECT conv_id, turn, {sql_sanitize('text')} AS digest FROM conversations WHERE role = 'assistant'"

QUERIES = {
    "canonical_url": (canonical_urls, CANONICAL_SQL),
    "fetchable_url": (fetchable_urls, FETCHABLE_SQL),
    "title_key": (title_keys, TITLE_KEYS_SQL),
    "strip_html": (plain_pages, PLAIN_PAGES_SQL),
    "decode_entities": (decoded_pages, DECODED_SQL),
    "strip_boilerplate": (boilerplate_free, BOILERPLATE_SQL),
    "truncate": (truncated, TRUNCATED_SQL),
    "excerpt": (excerpts, EXCERPTS_SQL),
    "normalize_items": (normalized_pages, NORMALIZED_SQL),
    "publish_time": (publish_times, PUBLISH_SQL),
    "local_date": (local_dates, LOCAL_DATES_SQL),
    "language_and_tokens": (languages_and_tokens, LANGUAGE_SQL),
    "article_text": (article_texts, _sql_article()),
    "article_acceptance": (accepted_articles, ACCEPTED_SQL),
    "redact_rows": (redacted, REDACTED_SQL),
    "sanitize_text": (sanitized, SANITIZED_SQL),
    "parse_response": (parsed_responses, PARSED_SQL),
    "parse_digest": (parsed_digests, DIGEST_SQL),
}
