"""Text normalisation as Spark column expressions.

Everything runs inside the JVM apart from Unicode compatibility folding, which Spark has
no function for; that step is a vectorised UDF fed only with the texts that need it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.session import let

# White space as the data model defines it (a regex character class body).
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Default length of an excerpt, in code points.
EXCERPT_MAX = 300

# Named character references that are decoded.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "#39": "'",
    "nbsp": " ",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "laquo": "«",
    "raquo": "»",
    "bull": "•",
    "middot": "·",
    "prime": "′",
    "Prime": "″",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "deg": "°",
    "times": "×",
    "divide": "÷",
    "plusmn": "±",
    "micro": "µ",
    "euro": "€",
    "pound": "£",
    "yen": "¥",
    "cent": "¢",
    "sect": "§",
    "para": "¶",
    "dagger": "†",
    "permil": "‰",
    "larr": "←",
    "rarr": "→",
    "harr": "↔",
    "ensp": " ",
    "emsp": " ",
    "thinsp": " ",
    "shy": "",
}

# Sentence enders and the punctuation that closes a sentence.
WIDE_ENDERS = "。！？…"
NARROW_ENDERS = ".!?"
CLOSERS = ")]}\"'”’」』）】"

_REFERENCE = r"(?i)&(#x?[0-9a-f]+|[a-z]+);"

# Texts made only of these characters are their own compatibility form: ASCII, the
# Latin-1 letters, plain Cyrillic and kana, Hangul syllables, unified ideographs and
# the common typographic marks. No combining mark is among them.
_ALREADY_FOLDED = (
    r"^[\x00-\x7F\u00c0-\u00ff\u0100-\u0131\u0410-\u044f\u2012-\u2016\u2018-\u201f"
    r"\u3041-\u3096\u30a1-\u30fa\u3001\u3002\u3008-\u3011\u4e00-\u9fff\uac00-\ud7a3]*$"
)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; ``length`` counts code points."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _numeric_reference(name: Column) -> Column:
    """``#8212`` or ``#x2014`` to its character; null when it names no character."""
    is_hex = F.lower(F.substring(name, 2, 1)) == "x"
    digits = F.regexp_replace(name, r"(?i)^#x?0*", "")
    leading = F.regexp_extract(name, "^#0*([0-9]*)", 1)
    code = F.when(
        is_hex & (F.length(digits) <= 6),
        F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("int"),
    ).when(
        # Letters behind the digits are read over.
        ~is_hex & name.rlike("^#[0-9]") & (F.length(leading) <= 7),
        F.conv(F.concat(F.lit("0"), leading), 10, 10).cast("int"),
    )

    def as_text(cp: Column) -> Column:
        # A lone surrogate has no UTF-8 form and a byte-order mark would be swallowed.
        return (
            F.when(cp.between(0xD800, 0xDFFF), F.lit("�"))
            .when(cp == 0xFEFF, F.lit("\ufeff"))
            .when(cp <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
        )

    return let(code, as_text)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters, in one pass."""
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(reference: Column) -> Column:
        name = F.substr(reference, F.lit(2))
        name = F.rtrim(F.regexp_replace(name, ";$", ""))
        return F.coalesce(
            F.try_element_at(table, name),
            F.try_element_at(table, F.lower(name)),
            F.when(name.startswith("#"), _numeric_reference(name)),
            reference,
        )

    between = F.split(text, _REFERENCE, -1)
    references = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    woven = F.zip_with(
        between, F.transform(references, decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(woven, "")).otherwise(text)


def strip_html(text: Column) -> Column:
    """Tags out, then references decoded, then white space collapsed."""
    return collapse_space(decode_entities(F.regexp_replace(text, "<[^>]*>", " ")))


def strip_boilerplate(text: Column, patterns: Column) -> Column:
    """Remove a source's own recurring phrases, in order and ignoring case."""
    cleaned = F.aggregate(
        F.coalesce(patterns, F.array().cast("array<string>")),
        text,
        lambda t, p: F.regexp_replace(t, F.concat(F.lit("(?i)"), p), F.lit(" ")),
    )
    return collapse_space(cleaned)


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` code points at the last sentence end that fills half of it.

    The sentence search is one greedy match. It sees one character beyond the limit, and
    asking for a further character after the match keeps the match within the limit. An
    ASCII ender counts only before white space and after a word of two characters or more
    that does not itself follow a full stop.
    """
    floor = -(-limit // 2)
    closers = "[" + "".join("\\" + c for c in CLOSERS) + "]*+"
    word = r"[\p{L}\p{N}]"
    # Only where an ender stands are the letters before it looked at.
    sentence = (
        rf"(?s)^(.*(?:[{WIDE_ENDERS}]{closers}"
        rf"|(?=[{NARROW_ENDERS}])(?<={word}{{2}})(?<!\.{word}{{2,{max(limit, 2)}}})[{NARROW_ENDERS}]{closers}(?=[{SPACE}])))(?=.)"
    )

    def shorten(head: Column, match: Column) -> Column:
        last_space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        at_word = F.when(last_space >= floor, F.left(head, last_space)).otherwise(head)
        ellipsis = F.concat(F.regexp_replace(at_word, f"[{SPACE}]+$", ""), F.lit("…"))
        return F.when(F.length(match) >= floor, trim_space(match)).otherwise(ellipsis)

    def cut(whole: Column) -> Column:
        sentences = F.regexp_extract(F.substring(whole, 1, limit + 1), sentence, 1)
        short = let(F.substring(whole, 1, limit - 1), lambda head: let(sentences, lambda match: shorten(head, match)))
        return F.when(F.length(whole) <= limit, whole).otherwise(short)

    # The text may be an expression over a whole document: it is evaluated once.
    return let(text, cut)


def excerpt(text: Column, patterns: Column | None = None, limit: int = EXCERPT_MAX) -> Column:
    """Plain, boilerplate-free, bounded text; null when nothing is left."""
    plain = strip_html(text)
    if patterns is not None:
        plain = strip_boilerplate(plain, patterns)
    return let(F.nullif(plain, F.lit("")), lambda t: truncate(t, limit))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatibility_form(text: Column) -> Column:
    """Unicode NFKC. Texts that cannot change are not sent to Python."""
    needed = F.when(~text.rlike(_ALREADY_FOLDED), text)
    return F.coalesce(_nfkc(needed), text)


def title_key(title: Column) -> Column:
    """A title without case, punctuation, symbols and spacing differences."""
    folded = compatibility_form(F.lower(title))
    return collapse_space(F.regexp_replace(folded, r"[\p{P}\p{S}]", " "))


def title_numbers(title: Column) -> Column:
    """The digit runs of a title, sorted as text."""
    return F.array_join(F.array_sort(F.regexp_extract_all(title, F.lit(r"(\d+)"), F.lit(1))), ",")


# Gram width and the fewest grams a title needs to be compared.
TITLE_GRAM = 4
MIN_GRAMS = 8


#: Titles are cut into pieces of this many characters before grams are taken, because
#: finding a character position in UTF-8 text costs time proportional to the position.
_PIECE = 256


def key_grams(key: Column) -> Column:
    """Distinct character grams of a title key with its spaces removed."""

    def piece_grams(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(piece) - (TITLE_GRAM - 1))
        return F.transform(starts, lambda i: F.substring(piece, i, TITLE_GRAM))

    def grams(text: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (TITLE_GRAM - 1), F.lit(_PIECE))
        pieces = F.transform(starts, lambda i: F.substring(text, i, _PIECE + TITLE_GRAM - 1))
        return F.when(
            F.length(text) >= TITLE_GRAM,
            F.array_distinct(F.flatten(F.transform(pieces, piece_grams))),
        ).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(key, f"[{SPACE}]+", ""), grams)


def title_language(title: Column) -> Column:
    letters = F.regexp_count(title, F.lit(r"\p{L}"))
    # Counted among letters only: a few Han characters are numbers, not letters.
    han = F.regexp_count(title, F.lit(r"[\p{IsHan}&&\p{L}]"))
    share = han / F.when(letters > 0, letters)
    return F.when(share >= 0.3, F.lit("zh")).otherwise(F.lit("other"))


def token_estimate(text: Column) -> Column:
    """About one token per CJK character and one per four others."""
    cjk = F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
    return F.ceil(cjk + (F.length(text) - cjk) / 4)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1")
