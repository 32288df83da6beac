"""Licence scans by canonical digest, in built-in functions only.

A text's canonical form has lower case, no title and no copyright lines, one spelling of words
that are spelled in several ways, and no punctuation. Its digest is looked up among the digests
of known licences, brought to the same form. Whole texts are looked up and, since notices stand
in texts as lines of their own, each line as a text of its own.

Known are the full texts of the short permissive licences and, of these and of the Apache, GNU,
Mozilla and Creative Commons licences, the notices that name them; ``licensed`` takes any other
list of texts. The known texts are a constant of the package, so their digests are a local table
of known size. Digests of whole texts and of lines that are as long as a known text are taken
in one pass over the texts and written without them; only lines that match are grouped.

Null and empty texts, and texts without words, match nothing. Every row gives one row; other
columns are kept, columns named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.session import dimension, let, materialize
from broadsheet.sources.tables import table

# The wording of licences and of their notices.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
_DISCLAIMED = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
    " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE"
    " USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this"
    " list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
    " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
    " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
    " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING"
    " IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction, including'
        " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
        " of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.\n\n" + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _DISCLAIMED,
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _DISCLAIMED),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission.\n" + _BSD_END,
    ),
]
# Licences by the name that the software package data exchange gives them, with
# the names that notices use.
NAMES = [
    ("MIT", ["MIT License"]),
    ("ISC", ["ISC License"]),
    ("0BSD", ["Zero-Clause BSD License", "0BSD License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "GNU LGPL v3"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "GNU AGPL v3"]),
    ("MPL-2.0", ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"]),
]
COMMONS = ["", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND"]
SPOKEN = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}


def _notices() -> list[tuple[str, str]]:
    """One-line notices of all names: who is named, in the usual sentences."""
    names = [(licence, name) for licence, spelled in NAMES for name in spelled]
    for kind in COMMONS:
        for version in ("2.0", "3.0", "4.0"):
            licence = f"CC-BY{kind}-{version}"
            parts = "-".join(SPOKEN[p] for p in f"BY{kind}".split("-"))
            names += [(licence, f"CC BY{kind} {version}"), (licence, f"Creative Commons {parts} {version} International License"), (licence, f"Creative Commons {parts} {version}")]
    names += [("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "Creative Commons CC0 1.0 Universal")]
    lead = ["Released under", "Licensed under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is released under"]
    out = [(licence, f"{words} {article}{name}") for licence, name in names for words in lead for article in ("the ", "a ", "")]
    tags = dict.fromkeys(licence for licence, _ in names)
    ends = {licence: ["", "-only", "-or-later"] if "GPL" in licence else [""] for licence in tags}
    return out + [(licence, f"SPDX-License-Identifier: {licence}{end}") for licence in tags for end in ends[licence]]


KNOWN += _notices()
SPELLINGS = [("licence", "license"), ("organisation", "organization"), ("authorisation", "authorization"), ("recognise", "recognize"), ("sub license", "sublicense"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("noninfringement", "non infringement"), ("https", "http")]
#: A first line that only names a licence.
TITLE = r"^[\s#*/;-]*(?:the[\x20]+)?(?:mit|isc|0bsd|(?:new|simplified|modified)?[\x20]*bsd|zero-clause[\x20]bsd)[^\n.:]{0,20}licen[cs]e(?:[\x20]*\([^\n]{1,20}\))?[\x20\t\r]*\n"
#: Copyright lines; without a sign or a year only at the start or behind an empty line.
COPYRIGHT = r"(?:^|\n[\x20\t\r]*\n)[\x20\t*#/;-]*copyright[\x20\t]+[^\n]*|(^|\n)[\x20\t*#/;-]*(?:copyright[\x20\t]+(?:\(c\)|©|[0-9])|\(c\)[\x20\t]*[0-9]|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[^a-z0-9\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The form in which equal licences are equal texts; a null text is empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return let(lowered, _canonical)


def _canonical(lowered: Column) -> Column:
    # Few texts hold what a copyright line or a title holds; only those are searched by pattern.
    marked = reduce(or_, (F.contains(lowered, F.lit(mark)) for mark in ("copyright", "(c)", "©", "all rights reserved")))
    out = F.when(marked, F.regexp_replace(lowered, COPYRIGHT, "")).otherwise(lowered)
    out = F.when(F.contains(lowered, F.lit("licen")), F.regexp_replace(out, TITLE, "")).otherwise(out)
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, " "), F.lit(" "))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.btrim(out, F.lit(" "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, licence, letters); texts with one canonical form count once."""
    schema = T.StructType([T.StructField("licence", T.StringType()), T.StructField("words", T.StringType())])
    rows = dimension(spark, [{"licence": name, "words": text} for name, text in known], schema)
    rows = rows.select("licence", canonical(F.col("words")).alias("words"))
    return rows.groupBy(F.sha2("words", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("words")).alias("letters"))


def licensed(docs: DataFrame, text: str = "text", known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``docs`` without its text, with digest (of the canonical form, null if it has no words),
    licence (of the whole text) and notices (licences of its lines, sorted)."""
    book = known_digests(docs.sparkSession, known)
    # No more than there are known texts.
    lengths = sorted(r[0] for r in book.select("letters").distinct().collect())
    kept = [c for c in docs.columns if c not in (text, "digest", "licence", "notices")]
    whole = F.sha2(canonical(F.col(text)), 256)
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)
    likely = F.filter(lines, lambda line: F.length(line).isin(lengths))
    looked = docs.select(
        F.struct(*kept).alias("_kept"),
        F.when(whole != F.sha2(F.lit(""), 256), whole).alias("_whole"),
        F.transform(likely, lambda line: F.sha2(line, 256)).alias("_lines"),
        F.monotonically_increasing_id().alias("_row"),
    )
    looked = materialize(looked, "licences")
    met = looked.filter(F.size("_lines") > 0).select("_row", F.explode("_lines").alias("digest")).join(book, "digest")
    met = met.groupBy(F.col("_row").alias("_met")).agg(F.array_sort(F.collect_set("licence")).alias("_notices"))
    rows = looked.join(book, F.col("_whole") == F.col("digest"), "left").join(met, F.col("_row") == F.col("_met"), "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *(F.col("_kept")[c].alias(c) for c in kept),
        F.col("_whole").alias("digest"),
        "licence",
        F.coalesce("_notices", none).alias("notices"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = licensed(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "digest", "licence", F.concat_ws(",", "notices").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {_quoted(COPYRIGHT)}, '', 'g')"
    out = f"regexp_replace({out}, {_quoted(TITLE)}, '')"
    out = f"concat(' ', regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g'), ' ')"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


ORACLE_SQL = f"""
WITH known AS (
  SELECT sha256({_canonical_sql("words")}) AS digest, min(licence) AS licence
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)}) AS k(licence, words) GROUP BY 1
), d AS (SELECT doc_id, text, sha256({_canonical_sql("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
met AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM lines JOIN known ON known.digest = sha256({_canonical_sql("line")}) GROUP BY doc_id
)
SELECT d.doc_id, nullif(d.digest, sha256('')) AS digest, known.licence, coalesce(met.notices, '') AS notices
FROM d LEFT JOIN known ON known.digest = d.digest LEFT JOIN met USING (doc_id)
"""
