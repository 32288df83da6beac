"""Readable text from article pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import SPACE, decode_entities, trim_space, utf16_length
from broadsheet.functions.urls import is_fetchable
from broadsheet.session import let

# Elements that are chrome, elements that may close themselves, elements
# that end a line, accepted content types and thresholds.
CHROME = (
    "script|style|noscript|template|svg|math|iframe|form|nav|aside|footer|header|figure"
    "|picture|video|audio|canvas|select|button"
)
SELF_CLOSING = "script|style|noscript|template|svg|iframe"
BLOCKS = (
    "p|div|section|article|main|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|blockquote"
    "|pre|figcaption"
)
HTML_TYPES = ["text/html", "application/xhtml+xml"]
MIN_ARTICLE = 200
MAX_LINK_SHARE = 0.6
MIN_LINE = 2
MIN_TEXT = 200
MAX_HTML = 2 * 1024 * 1024
MAX_TEXT = 6000

# Private-use marks around link text; they never leave this module.
_OPEN, _CLOSE = "\ue000", "\ue001"


def _main_region(html: Column) -> Column:
    """The longest article, else the longest main element, else the body, else all."""

    def longest(tag: str) -> Column:
        found = F.regexp_extract_all(
            html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)
        )
        sized = F.transform(
            found, lambda t, i: F.struct(utf16_length(t).alias("n"), (-i).alias("i"), t.alias("t"))
        )
        return let(F.array_max(sized), lambda best: F.when(best["n"] > MIN_ARTICLE, best["t"]))

    body = F.when(
        html.rlike(r"(?is)<body\b[^>]*>.*?</body\s*>"),
        F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)</body\s*>", 1),
    )
    return F.coalesce(longest("article"), longest("main"), body, html)


def _mostly_links(line: Column) -> Column:
    """Whether link text makes up more than the allowed share of a line's characters."""
    spans = F.array_join(F.regexp_extract_all(line, F.lit(f"{_OPEN}[^{_CLOSE}]*"), F.lit(0)), "")
    blanks = f"[{_OPEN}{_CLOSE}{SPACE}]"
    linked = F.length(F.regexp_replace(spans, blanks, ""))
    total = F.length(F.regexp_replace(line, blanks, ""))
    return F.contains(line, F.lit(_OPEN)) & (
        (total <= 0) | (linked / F.nullif(total, F.lit(0)) > MAX_LINK_SHARE)
    )


def html_to_text(html: Column) -> Column:
    """Article text, one block per line, without chrome, menus and fragments.

    One chain of JVM regular expressions and array functions; pages never visit Python.
    """
    chrome = rf"(?is)<({CHROME})\b[^>]*>.*?</\1\s*>"
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    clean = F.regexp_replace(clean, rf"(?i)<(?:{SELF_CLOSING})\b[^>]*/>", " ")
    # Twice, because an element inside a removed one can hide its end from the first pass.
    clean = F.regexp_replace(F.regexp_replace(clean, chrome, " "), chrome, " ")

    def lines(region: Column) -> Column:
        marked = F.regexp_replace(region, r"(?i)<a\b[^>]*>", _OPEN)
        marked = F.regexp_replace(marked, r"(?i)</a\s*>", _CLOSE)
        marked = F.regexp_replace(marked, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
        return F.split(decode_entities(F.regexp_replace(marked, "<[^>]*>", " ")), "\n")

    def squeeze(line: Column) -> Column:
        return trim_space(F.regexp_replace(line, " {2,}", " "))

    def finish(all_lines: Column) -> Column:
        tidy = F.transform(all_lines, lambda x: squeeze(F.regexp_replace(x, r"[\t\r\u00a0]", " ")))
        prose = F.filter(tidy, lambda x: ~_mostly_links(x))
        bare = F.transform(prose, lambda x: squeeze(F.regexp_replace(x, f"[{_OPEN}{_CLOSE}]", "")))
        kept = F.filter(bare, lambda x: F.length(x) >= MIN_LINE)
        return trim_space(F.array_join(kept, "\n"))

    return finish(lines(let(clean, _main_region)))


def extract_articles(
    pages: DataFrame,
    max_html: int = MAX_HTML,
    min_chars: int = MIN_TEXT,
    max_chars: int = MAX_TEXT,
) -> DataFrame:
    """Add ``article, input_kind, reason`` to fetched pages.

    Needs ``url, status, content_type, html``. A refused page keeps its excerpt as input
    and says why.
    """
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    size = utf16_length(F.col("html"))
    early = (
        F.when(~is_fetchable(F.col("url")), "refused url (not a public http(s) address)")
        .when(~F.col("status").between(200, 299), F.format_string("HTTP %d", "status"))
        .when(
            ~F.coalesce(kind.isin(HTML_TYPES), F.lit(False)),
            F.concat(
                F.lit("not html (content-type: "),
                F.coalesce("content_type", F.lit("none")),
                F.lit(")"),
            ),
        )
        .when(size > max_html, F.format_string("page too large: %d chars > %d", size, F.lit(max_html)))
    )
    read = pages.withColumn("reason", early).withColumn(
        "_text", F.when(F.col("reason").isNull(), html_to_text(F.col("html")))
    )
    short = F.length("_text") < min_chars
    return (
        read.withColumn(
            "reason",
            F.when(
                short,
                F.format_string(
                    "extracted only %d chars (< %d)", F.length("_text"), F.lit(min_chars)
                ),
            ).otherwise(F.col("reason")),
        )
        .withColumn("article", F.when(~short, F.left("_text", F.lit(max_chars))))
        .withColumn(
            "input_kind",
            F.when(F.col("article").isNotNull(), "fulltext").otherwise("excerpt"),
        )
        .drop("_text")
    )
