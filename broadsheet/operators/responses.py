"""Request rows for an external model, and what comes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import SPACE, strip_html, token_estimate, trim_space, truncate
from broadsheet.operators.topk import top_k
from broadsheet.session import let, materialize

# Fences, labels and version of a request.
PROMPT_VERSION = "1"
FENCE_OPEN = "<<<ITEM_DATA>>>"
FENCE_CLOSE = "<<<END_ITEM_DATA>>>"
TITLE_LABEL, SOURCE_LABEL, BODY_LABEL = "标题：", "来源：", "正文："
NO_BODY = "(无正文，只有标题)"

# Patterns removed from a response, in this order.
CODE_FENCE = r"(?i)^\s*```[a-z]*\s*|\s*```\s*$"
MARKDOWN_LINK = r"!?\[([^\]]*)\]\([^)]*\)"
BARE_URL = r"(?i)\b(?:[a-z][a-z0-9+.-]*://|www\.)\S+"
BARE_DOMAIN_PATH = r"(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/\S*"
CONTROL = r"[\u0000-\u001f\u007f]"
INVISIBLE = r"[\u200b-\u200f\u2028\u2029\u202a-\u202e\u2066-\u2069\ufeff]"
LEADING_LABEL = r"(?i)^\s*(?:摘要|概括|总结|要点|summary|tl;?dr)\s*[:：、-]\s*"
LEADING_BULLET = r"^\s*(?:[-*•·]|\d+[.)、])\s*"
MAX_TAKEAWAYS = 3

# What is said of calls without a result, and the defaults of a digest.
NO_SUMMARY = "model returned nothing usable after sanitizing"
NO_DIGEST = "model returned nothing usable"
DIGEST_WARNING = "llm digest: no 导读 this issue — "
DIGEST_ITEMS, DIGEST_ITEM_CHARS, DIGEST_CHARS = 24, 120, 240


def defenced(text: Column) -> Column:
    """Data must not be able to close its own fence."""
    opened = F.replace(text, F.lit(FENCE_OPEN), F.lit(" "))
    return F.replace(opened, F.lit(FENCE_CLOSE), F.lit(" "))


def request_rows(tasks: DataFrame) -> DataFrame:
    """One request per planned task: fenced title, source and body."""
    body = F.concat_ws(
        "\n",
        F.lit(FENCE_OPEN),
        F.concat(F.lit(TITLE_LABEL), defenced(F.col("title"))),
        F.concat(F.lit(SOURCE_LABEL), defenced(F.col("source"))),
        F.concat(
            F.lit(BODY_LABEL),
            F.coalesce(F.nullif(defenced(F.col("input")), F.lit("")), F.lit(NO_BODY)),
        ),
        F.lit(FENCE_CLOSE),
    )
    return tasks.select(
        "run_id", F.col("id").alias("item_id"), F.lit(PROMPT_VERSION).alias("prompt_version"), body.alias("body")
    )


def sanitize_plain(text: Column) -> Column:
    """A response text without links, markup, control and invisible characters."""
    out = F.regexp_replace(text, CODE_FENCE, " ")
    out = F.regexp_replace(out, MARKDOWN_LINK, "$1")
    out = F.regexp_replace(F.regexp_replace(out, BARE_URL, " "), BARE_DOMAIN_PATH, " ")
    out = strip_html(out)
    out = F.regexp_replace(F.regexp_replace(out, CONTROL, " "), INVISIBLE, "")
    out = F.regexp_replace(out, LEADING_LABEL, "")
    return F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))


def sanitize_text(text: Column, max_chars: int) -> Column:
    return let(sanitize_plain(text), lambda t: truncate(t, max_chars))


def sanitize_takeaways(entries: Column, max_chars: int) -> Column:
    """Bullets off, cleaned, empties and repeats out, the first few kept."""
    cleaned = F.transform(
        entries, lambda e: sanitize_text(F.regexp_replace(e, LEADING_BULLET, ""), max_chars)
    )
    distinct = F.array_distinct(F.filter(cleaned, lambda t: t != ""))
    return F.coalesce(F.slice(distinct, 1, MAX_TAKEAWAYS), F.array().cast("array<string>"))


def response_object(raw: Column) -> Column:
    """The JSON object in a response as a variant, or null.

    The whole text without its code fence is tried first, then the part from the first
    opening to the last closing brace. Arrays and scalars do not count.
    """

    def as_object(text: Column) -> Column:
        value = F.try_parse_json(text)
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)

    bare = trim_space(F.regexp_replace(raw, CODE_FENCE, ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(as_object(bare), as_object(F.nullif(inner, F.lit(""))))


def text_field(value: Column, path: str) -> Column:
    """A field of a variant when it holds text; null otherwise."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def _text_entries(value: Column, path: str) -> Column:
    entries = F.try_variant_get(value, path, "array<variant>")
    texts = F.filter(entries, lambda e: F.schema_of_variant(e) == "STRING")
    return F.transform(texts, lambda e: F.try_variant_get(e, "$", "string"))


def parse_responses(responses: DataFrame, max_chars: int) -> DataFrame:
    """Add ``summary`` and ``takeaways``; responses with nothing usable are null.

    Prose without JSON is the summary. JSON without a usable summary promotes its first
    takeaway.
    """
    empty = F.array().cast("array<string>")
    parsed = responses.withColumn("_json", response_object(F.col("raw")))
    read = parsed.withColumn("_is_json", F.col("_json").isNotNull()).select(
        "*",
        F.when(
            F.col("_is_json"),
            sanitize_text(F.coalesce(text_field(F.col("_json"), "$.summary"), F.lit("")), max_chars),
        )
        .otherwise(sanitize_text(F.col("raw"), max_chars))
        .alias("_summary"),
        F.when(
            F.col("_is_json"),
            sanitize_takeaways(_text_entries(F.col("_json"), "$.takeaways"), max_chars),
        )
        .otherwise(empty)
        .alias("_takeaways"),
    )
    promote = F.col("_summary") == ""
    return (
        read.withColumn(
            "summary",
            F.when(~promote, F.col("_summary")).otherwise(F.try_element_at("_takeaways", F.lit(1))),
        )
        .withColumn(
            "takeaways",
            F.when(F.col("summary").isNull(), F.lit(None))
            .when(promote, F.slice("_takeaways", 2, MAX_TAKEAWAYS))
            .otherwise(F.col("_takeaways")),
        )
        .drop("_json", "_is_json", "_summary", "_takeaways")
    )


def parse_digest(raw: Column, max_chars: int) -> Column:
    """``digest``, else ``summary``, else the prose; empty when JSON has neither."""

    def read(value: Column) -> Column:
        digest = F.try_variant_get(value, "$.digest", "variant")
        # An explicit null is a variant of its own, not a missing value.
        present = F.coalesce(
            F.when(~F.is_variant_null(digest), digest),
            F.try_variant_get(value, "$.summary", "variant"),
        )
        text = F.when(
            F.schema_of_variant(present) == "STRING", F.try_variant_get(present, "$", "string")
        )
        return F.when(value.isNotNull(), F.coalesce(text, F.lit(""))).otherwise(raw)

    return sanitize_text(read(response_object(raw)), max_chars)


def merge_summaries(items: DataFrame, summaries: DataFrame) -> DataFrame:
    """Attach summaries by run and item; the excerpt stays what it was."""
    found = summaries.select(
        "run_id",
        F.col("item_id").alias("id"),
        F.col("summary").alias("_summary"),
        F.when(F.size("takeaways") > 0, F.col("takeaways")).alias("_takeaways"),
        F.struct(
            F.lit("llm").alias("by"), "model", "prompt_version", "input_kind"
        ).alias("_meta"),
    ).where(F.col("_summary").isNotNull())
    bare = items.drop("summary", "takeaways", "summary_meta")
    return (
        bare.join(found, ["run_id", "id"], "left")
        .withColumnRenamed("_summary", "summary")
        .withColumnRenamed("_takeaways", "takeaways")
        .withColumnRenamed("_meta", "summary_meta")
    )


def effective_body() -> Column:
    """What is shown under a title: the summary, else the excerpt."""
    return F.coalesce("summary", "excerpt")


def compare_versions(
    archived: DataFrame, summaries: DataFrame, model: str, prompt_version: str
) -> DataFrame:
    """Archived excerpts beside newly made summaries, only items that got one."""
    chosen = summaries.where(
        (F.col("model") == model)
        & (F.col("prompt_version") == prompt_version)
        & F.col("summary").isNotNull()
    ).select("run_id", F.col("item_id").alias("id"), "summary", "model", "prompt_version", "input_kind")
    return archived.select("run_id", "id", "section_pos", "rank_in_section", "title", "excerpt").join(
        chosen, ["run_id", "id"]
    )


def digest_entries(items: DataFrame, max_items: int, max_chars: int) -> DataFrame:
    """The first items of an issue in section and rank order, title and body cut."""
    first = top_k(
        items,
        ["run_id"],
        [F.asc("section_pos"), F.asc("rank_in_section")],
        max_items,
        rank="entry",
    )
    body = F.coalesce(effective_body(), F.lit(""))
    return first.withColumn("title", F.left("title", F.lit(max_chars))).withColumn(
        "body", F.left(body, F.lit(max_chars))
    )


def digest_tokens(entries: DataFrame) -> DataFrame:
    """Estimated tokens of a digest request per run."""
    one = token_estimate(F.col("title")) + token_estimate(F.col("body")) + 2
    return entries.groupBy("run_id").agg(F.sum(one).alias("tokens"))


def _error(answers: DataFrame) -> Column:
    """Why a call failed, if its answer says so."""
    return F.col("error") if "error" in answers.columns else F.lit(None).cast("string")


def digests(
    items: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    max_items: int = DIGEST_ITEMS,
    item_chars: int = DIGEST_ITEM_CHARS,
    max_chars: int = DIGEST_CHARS,
) -> DataFrame:
    """(run_id, digest, warning): one row per run with items, with a digest or a warning.

    ``answer`` gets the digest's entries, ordered by ``entry`` within a run, and gives one raw
    answer per run (run_id, model, prompt_version, raw, and perhaps error). A run without an
    answer, or whose answer holds no text, keeps its issue and gets a warning.
    """
    entries = materialize(digest_entries(items, max_items, item_chars), "entries")
    answers = answer(entries)
    read = answers.select("run_id", "model", "prompt_version", _error(answers).alias("error"), parse_digest(F.col("raw"), max_chars).alias("text"))
    told = entries.select("run_id").distinct().join(read, "run_id", "left")
    usable = F.col("error").isNull() & (F.coalesce("text", F.lit("")) != "")
    meta = F.struct(F.lit("llm").alias("by"), "model", "prompt_version", F.lit("summaries").alias("input_kind"))
    return told.select(
        "run_id",
        F.when(usable, F.struct("text", meta.alias("meta"))).alias("digest"),
        F.when(~usable, F.concat(F.lit(DIGEST_WARNING), F.coalesce("error", F.lit(NO_DIGEST)))).alias("warning"),
    )


def summary_failures(tasks: DataFrame, answers: DataFrame, parsed: DataFrame) -> DataFrame:
    """(run_id, message, pos) of planned tasks that got no summary, by their place in the issue.

    ``answers`` are the raw answers, which may carry an error; ``parsed`` is what was read.
    """
    done = parsed.where(F.col("summary").isNotNull()).select("run_id", F.col("item_id").alias("id"))
    said = answers.groupBy("run_id", F.col("item_id").alias("id")).agg(F.min(_error(answers)).alias("message"))
    lost = tasks.join(done, ["run_id", "id"], "left_anti").join(said, ["run_id", "id"], "left")
    return lost.select("run_id", F.coalesce("message", F.lit(NO_SUMMARY)).alias("message"), F.struct("section_pos", "rank_in_section").alias("pos"))
