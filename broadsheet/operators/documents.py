"""Issue documents per audience and size-bounded packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import escape_markdown, trim_space, truncate
from broadsheet.functions.urls import host_name
from broadsheet.operators.responses import effective_body
from broadsheet.session import let

# Channels read as notifications, digest headings, size limits and labels.
PUSH_CHANNELS = ["wecom", "telegram", "serverchan", "pushplus", "wxpusher"]
DIGEST_TITLE, WEEKLY_DIGEST_TITLE = "今日导读", "本周导读"
WARNINGS_LABEL, TEXT_WARNINGS_LABEL = "抓取告警", "抓取告警："
COMPACT_CHARS = 100
MAX_UNITS = 4096


def signatures(audiences: list[dict], section_ids: list[str]) -> list[dict]:
    """Audiences with their resolved detail and document signature.

    Equal sections in any order, format and detail mean one document. The wildcard becomes
    the list of all sections, so a document's rows are found by an equi-join.
    """
    out = []
    for a in audiences:
        detail = a.get("detail") or ("compact" if a.get("channel") in PUSH_CHANNELS else "full")
        named = sorted(a["sections"])
        key = "|".join([",".join(named), a["format"], detail])
        chosen = section_ids if "*" in named else [s for s in section_ids if s in named]
        out.append({**a, "detail": detail, "signature": key, "chosen": chosen})
    return out


def with_signatures(issues: DataFrame, signed: list[dict]) -> DataFrame:
    """Every issue once per distinct signature; the list comes from configuration."""
    distinct = {s["signature"]: s for s in signed}
    kinds = F.array(
        *[
            F.struct(
                F.lit(k).alias("signature"),
                F.array(*[F.lit(c) for c in s["chosen"]]).cast("array<string>").alias("chosen"),
                F.lit(s["format"]).alias("format"),
                F.lit(s["detail"]).alias("detail"),
            )
            for k, s in sorted(distinct.items())
        ]
    )
    return issues.select("*", F.inline(kinds))


def audience_documents(documents: DataFrame, signed: list[dict]) -> DataFrame:
    """Hand each audience the document of its signature."""
    pairs = F.array(
        *[F.struct(F.lit(s["id"]).alias("audience"), F.lit(s["signature"]).alias("_s")) for s in signed]
    )
    mine = F.filter(pairs, lambda p: p["_s"] == F.col("signature"))
    return documents.select("*", F.inline(mine)).drop("_s")


def body_text(compact_chars: int = COMPACT_CHARS) -> Column:
    """The body at the wanted detail."""
    body = effective_body()
    return F.when(F.col("detail") == "compact", truncate(body, compact_chars)).otherwise(body)


def _item_block(form: str, compact_chars: int) -> Column:
    number = (F.col("position") + 1).cast("string")
    body = body_text(compact_chars)
    bullets = F.when(F.col("detail") != "compact", F.coalesce("takeaways", F.array().cast("array<string>")))
    bullets = F.coalesce(bullets, F.array().cast("array<string>"))
    if form == "markdown":
        score = F.when(F.col("score") > 0, _plain_number(F.col("score")))
        meta = F.concat_ws(" · ", "source", host_name(F.col("url")), score)
        return F.concat_ws(
            "\n",
            F.concat(number, F.lit(". ["), escape_markdown(F.col("title")), F.lit("]("), F.col("url"), F.lit(")")),
            F.concat(F.lit("   "), escape_markdown(meta)),
            F.concat(F.lit("   "), escape_markdown(F.nullif(body, F.lit("")))),
            F.transform(bullets, lambda t: F.concat(F.lit("   - "), escape_markdown(t))),
        )
    return F.concat_ws(
        "\n",
        F.concat(number, F.lit(". "), F.col("title")),
        F.concat(F.lit("   "), F.col("url")),
        F.concat(F.lit("   "), F.nullif(body, F.lit(""))),
        F.transform(bullets, lambda t: F.concat(F.lit("   - "), t)),
    )


def _plain_number(value: Column) -> Column:
    """A whole number without its decimals."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        value.cast("string")
    )


def document_blocks(
    issues: DataFrame,
    items: DataFrame,
    signed: list[dict],
    digest_position: str = "top",
    compact_chars: int = COMPACT_CHARS,
) -> DataFrame:
    """(run_id, signature, ord, block) rows of every document.

    ``issues`` has ``run_id, title, date, schedule_id, timezone, digest (text), warnings``;
    ``items`` has line-up rows with ``section_title``. Sections without items do not show.
    """
    heads = with_signatures(issues, signed)
    weekly = F.col("schedule_id") == "weekly"
    label = F.when(weekly, WEEKLY_DIGEST_TITLE).otherwise(DIGEST_TITLE)
    is_text = F.col("format") == "text"
    name = F.concat(F.col("title"), F.lit(" · "), F.col("date"))
    digest_md = F.concat(
        F.lit("> **"), escape_markdown(label), F.lit("**\n> "), escape_markdown(F.col("digest"))
    )
    digest_text = F.concat(F.lit("【"), label, F.lit("】\n"), F.col("digest"))
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    warn_md = F.concat_ws(
        "\n",
        F.lit(f"> {WARNINGS_LABEL}"),
        F.transform(warnings, lambda w: F.concat(F.lit("> - "), escape_markdown(w))),
    )
    warn_text = F.concat_ws(
        "\n", F.lit(TEXT_WARNINGS_LABEL), F.transform(warnings, lambda w: F.concat(F.lit("- "), w))
    )
    footer = F.concat_ws(" · ", F.concat(F.lit("—— "), F.col("title")), "schedule_id", "timezone")

    def block(a: int, text: Column) -> Column:
        return F.struct(
            F.struct(F.lit(a).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"),
            text.alias("block"),
        )

    frame = F.array(
        block(0, F.when(is_text, name).otherwise(F.concat(F.lit("# "), name))),
        block(
            1 if digest_position != "bottom" else 3,
            F.when(is_text, digest_text).otherwise(digest_md),
        ),
        block(4, F.when(F.size(warnings) > 0, F.when(is_text, warn_text).otherwise(warn_md))),
        block(5, F.when(~is_text, footer)),
    )
    frames = heads.select("run_id", "signature", F.inline(frame)).where(F.col("block").isNotNull())

    wanted = heads.select("run_id", "signature", "format", "detail", F.explode("chosen").alias("section"))
    rows = items.withColumnRenamed("rank_in_section", "position").join(wanted, ["run_id", "section"])
    at = F.struct(
        F.lit(2).alias("a"), F.col("section_pos").alias("b"), (F.col("position") + 1).alias("c")
    )
    bodies = rows.select(
        "run_id",
        "signature",
        at.alias("ord"),
        F.when(is_text, _item_block("text", compact_chars))
        .otherwise(_item_block("markdown", compact_chars))
        .alias("block"),
    )
    # The first item of a section brings its heading along.
    heading_text = F.when(
        is_text, F.concat(F.lit("【"), F.col("section_title"), F.lit("】"))
    ).otherwise(F.concat(F.lit("## "), escape_markdown(F.col("section_title"))))
    headings = rows.where(F.col("position") == 0).select(
        "run_id",
        "signature",
        F.struct(F.lit(2).alias("a"), F.col("section_pos").alias("b"), F.lit(0).alias("c")).alias("ord"),
        heading_text.alias("block"),
    )
    return frames.unionByName(bodies).unionByName(headings)


def assemble(blocks: DataFrame) -> DataFrame:
    """One document per issue and signature: its blocks in order and the joined body.

    An issue's blocks are bounded by the sections' limits.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "block")))
    return (
        blocks.groupBy("run_id", "signature")
        .agg(ordered.alias("rows"))
        .select(
            "run_id",
            "signature",
            F.transform("rows", lambda r: r["block"]).alias("blocks"),
        )
        .withColumn("body", F.concat(F.array_join("blocks", "\n\n"), F.lit("\n")))
    )


def _width(text: Column, unit: str) -> Column:
    return F.octet_length(text) if unit == "bytes" else F.char_length(text)


def _pieces(block: Column, limit: int, unit: str) -> Column:
    """A block that fits nowhere, cut between characters by one pattern in one pass.

    For bytes the pattern sees each byte as a letter: as many as the limit allows, but not up to
    a byte that goes on with a character; a character wider than the limit stands alone.
    """
    if unit == "chars":
        return F.regexp_extract_all(block, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
    pattern = rf"(?s).{{1,{limit}}}(?![\x80-\xBF])|.[\x80-\xBF]*"
    letters = F.decode(F.encode(block, "UTF-8"), "ISO-8859-1")
    found = F.regexp_extract_all(letters, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda p: F.decode(F.encode(p, "ISO-8859-1"), "UTF-8"))


def _starts(pieces: Column, limit: int, gap: int) -> Column:
    """Where chunks begin among the pieces (text, width, whole), counted from 1: a fold over the
    size of the open chunk, which is -1 where none is open."""

    def step(state: Column, piece: Column) -> Column:
        joins = piece["whole"] & (state["size"] >= 0) & (state["size"] + gap + piece["width"] <= limit)
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(joins, state["size"] + gap + piece["width"]).when(piece["whole"], piece["width"]).otherwise(-1).alias("size"),
            F.when(joins, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["at"]))).alias("starts"),
        )

    zero = F.struct(F.lit(1).alias("at"), F.lit(-1).alias("size"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(pieces, zero, step, lambda state: state["starts"])


def pack_blocks(
    blocks: Column, limit: int = MAX_UNITS, unit: str = "bytes", separator: str = "\n\n"
) -> Column:
    """Pack a document's blocks, in order and unbroken, into chunks of at most ``limit``.

    A document is one row, so nothing moves. Null and empty blocks are passed over, a null list
    stays null.
    """
    gap = len(separator.encode()) if unit == "bytes" else len(separator)

    def cut(block: Column) -> Column:
        width = _width(block, unit)
        whole = F.array(F.struct(block.alias("text"), width.alias("width"), F.lit(True).alias("whole")))
        alone = F.transform(
            _pieces(block, limit, unit),
            lambda p: F.struct(p.alias("text"), F.lit(0).alias("width"), F.lit(False).alias("whole")),
        )
        return F.when(width <= limit, whole).otherwise(alone)

    def chunks(pieces: Column) -> Column:
        def join(starts: Column) -> Column:
            def chunk(start: Column, i: Column) -> Column:
                after = F.coalesce(F.get(starts, i + 1), F.size(pieces) + 1)
                return F.array_join(F.slice(pieces, start, after - start)["text"], separator)

            return F.transform(starts, chunk)

        return let(_starts(pieces, limit, gap), join)

    return let(F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), cut)), chunks)


def paragraphs(text: Column) -> Column:
    """A document's blocks: what blank lines separate."""
    return F.transform(F.split(text, r"\n{2,}"), trim_space)

