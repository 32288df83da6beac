"""Secret scans judged by corpus-wide ownership frequency.

Each whole text is scanned for candidates; a digest of every candidate value is counted over
distinct owners and repositories. A value that more than ``OWNERS`` owners or more than
``REPOSITORIES`` repositories carry is a widely copied example; one that few carry and that
looks alive (varied letters, no placeholder) is a live credential. Values that stand without a
telling name are candidates too (kind ``opaque``): they are reported only if they are live.

Copies of one text (by a 64-bit hash) count once, for the smallest owner and repository that
has one: a document that others copied whole does not make its credential an example.

Counting goes copy by copy, then owner by owner, then value by value, all with partial sums on
the map side, so a value in a third of all documents costs one row a task and text. The scan is
written once to the shared folder with a row number; both later passes read that table.

Null and empty texts have no candidates. A null owner is one owner. A null repository
counts as one repository of its owner. Every row gives one row, repeated rows too. Columns of
any name stay, but for the text and a column named ``found``, which ``secrets`` replaces;
``redacted`` keeps that one too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.words import sliced
from broadsheet.session import materialize
from broadsheet.sources.tables import table

#: A value that more owners carry is an example, or more repositories, whoever owns them.
OWNERS, REPOSITORIES = 2, 20
#: Bits a letter that a live value has at least; a short value, whose letters cannot vary as
#: much, only what nearly all random values of its length and alphabet have.
ENTROPY = {"assign": 3.0, "access": 3.0, "hex": 3.0, "opaque": 3.5}

# The kinds, in order, with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "opaque"]

OPAQUE = re.compile(r"[A-Za-z0-9_-]{24,}")
ALPHABETS = [(re.compile(p), n) for p, n in (("[0-9]+", 10), ("[0-9a-f]+|[0-9A-F]+", 16), ("[a-z]+|[A-Z]+", 26), ("[0-9a-z]+|[0-9A-Z]+", 36), ("[0-9A-Za-z]+", 62))]
SHORTEST, SHORT = 12, 64
PLACEHOLDER = re.compile(r"example|sample|dummy|test|changeme|your|xxxx|(.)\1{5}", re.IGNORECASE)

SPAN = "struct<kind:string,start:bigint,end:bigint,digest:string,alive:boolean,base:boolean>"


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random_entropy(n: int, letters: int) -> float:
    """The entropy of a random value of ``n`` letters less four standard deviations."""
    bits = [-c / n * math.log2(c / n) if c else 0.0 for c in range(n + 1)]
    one = [math.comb(n, c) * (letters - 1) ** (n - c) / letters**n for c in range(n + 1)]
    mean, square = sum(p * b for p, b in zip(one, bits)), sum(p * b * b for p, b in zip(one, bits))
    both = sum(
        math.comb(n, c) * math.comb(n - c, d) * (letters - 2) ** (n - c - d) / letters**n * bits[c] * bits[d]
        for c in range(1, n + 1)
        for d in range(1, n - c + 1)
    )
    variance = letters * (square - mean * mean) + letters * (letters - 1) * (both - mean * mean)
    return letters * mean - 4 * math.sqrt(max(0.0, variance))


#: ``_random_entropy`` by length and letters, filled on the driver before the scan ships it.
_REACHED: dict[tuple[int, int], float] = {}


def _reached(n: int, letters: int) -> float:
    if (n, letters) not in _REACHED:
        _REACHED[n, letters] = _random_entropy(n, letters)
    return _REACHED[n, letters]


def _alphabet(value: str) -> int:
    """How many letters the smallest usual alphabet of a value has."""
    for pattern, letters in ALPHABETS:
        if pattern.fullmatch(value):
            return letters
    return 64


def _least(kind: str, value: str) -> float:
    # Random values of more letters reach the fixed bound in any alphabet.
    return min(ENTROPY[kind], _reached(len(value), _alphabet(value))) if len(value) <= SHORT else ENTROPY[kind]


def _alive(kind: str, value: str) -> bool:
    return _entropy(value) >= _least(kind, value) and not PLACEHOLDER.search(value)


def candidates(text: str | None) -> list[dict]:
    """All candidates of a text by start, then kind; ``base`` are those of the first kinds."""
    text = text or ""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(s, e) for _, s, e, _ in found]
    for m in OPAQUE.finditer(text):
        value = m[0]
        mixed = re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)
        if mixed and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append(("opaque", m.start(), m.end(), value))
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return [
        {"kind": k, "start": s, "end": e, "digest": hashlib.sha256(v.encode()).hexdigest(), "alive": bool(_alive(k, v)), "base": k != "opaque"}
        for k, s, e, v in found
    ]


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``found``: its candidates."""
    kept = [c for c in docs.columns if c not in (text, "found")]
    schema = docs.select(*kept).schema.add("found", T.DataType.fromDDL(f"array<{SPAN}>"))

    for letters in (64, *(n for _, n in ALPHABETS)):
        for n in range(SHORTEST, SHORT + 1):
            _reached(n, letters)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string()), ("alive", pa.bool_()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = pa.array([candidates(v.as_py()) for v in batch.column(text)], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, "found"])

    return docs.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """digest -> n_owners, n_repositories over rows of (digest, copy, owner, repository); rows of
    one digest and copy count as the smallest of them."""
    return (
        found.groupBy("digest", "copy")
        .agg(F.min(F.struct("owner", "repository")).alias("first"))
        .select("digest", "first.owner", "first.repository")
        .distinct()
        .groupBy("digest", "owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    )


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def secrets(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text", owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """``docs`` without its text, with ``found``: array of (kind, start, end, base, verdict,
    n_owners, n_repositories); verdict is live, example or placeholder. Opaque candidates
    stay only if live."""
    row, copy = _free(docs, "_row", "_copy")
    numbered = docs.withColumns({row: F.monotonically_increasing_id(), copy: F.xxhash64(text)})
    table_ = materialize(scanned(numbered, text), "secrets")
    spans = table_.select(
        F.col(row).alias("_row"),
        F.col(copy).alias("copy"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.explode("found").alias("f"),
    ).select("_row", "copy", "owner", "repository", "f.*")
    counts = materialize(ownership(spans), "owners")
    copied = (F.col("n_owners") > owners) | (F.col("n_repositories") > repositories)
    verdict = F.when(~F.col("alive"), "placeholder").when(copied, "example").otherwise("live")
    judged = (
        spans.drop("copy", "owner", "repository")
        .join(counts, "digest")
        .withColumn("verdict", verdict)
        .filter(F.col("base") | (F.col("verdict") == "live"))
        .withColumn("order", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end", "base", "verdict", "n_owners", "n_repositories"))).alias("found"))
        .withColumnRenamed("_row", row)
    )
    none = F.array().cast(judged.schema["found"].dataType)
    return table_.drop("found", copy).join(judged, row, "left").withColumn("found", F.coalesce("found", none)).drop(row)


def redacted(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text", mask: str = "<secret>") -> DataFrame:
    """``docs`` with live credentials masked in ``text``; all rows and columns stay."""
    key, digest, spans = _free(docs, "_id", "_hash", "_live")
    keyed = docs.withColumns({key: F.coalesce(F.col(repository).cast("string"), F.lit("")), digest: F.xxhash64(text)})
    live = (
        secrets(keyed.select(key, digest, *dict.fromkeys((owner, repository, text))), owner, repository, text)
        .select(key, digest, F.filter("found", lambda f: f["verdict"] == "live").alias(spans))
        .filter(F.size(spans) > 0)
        .dropDuplicates([key, digest])
    )
    # Overlapping spans of different kinds are cut once: what is behind the last cut is kept.
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def cut(state, span):
        fresh = span["end"] > state["at"]
        gap = F.substr(F.col(text), (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        joined = F.when(span["start"] >= state["at"], F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"])
        return F.struct(
            F.when(fresh, joined).otherwise(state["done"]).alias("done"),
            F.greatest(span["end"], state["at"]).alias("at"),
        )

    masked = F.aggregate(spans, start, cut, lambda s: F.concat(s["done"], F.substr(F.col(text), (s["at"] + 1).cast("int"))))
    joined = keyed.join(live, [key, digest], "left")
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), masked).otherwise(F.col(text))).select(*docs.columns)


def _joined(spans) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))


def _count(field: str, value: str) -> Column:
    return F.size(F.filter("found", lambda f: f[field] == value)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: base counts, digest of the base spans, all spans and the live ones, and of
    all spans the owners and repositories that carry the value."""
    found = secrets(docs.select("doc_id", "source", "text"))
    counts = [_count("kind", k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("found", lambda f: f["base"])
    live = F.filter("found", lambda f: f["verdict"] == "live")
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        _joined(live).alias("live_spans"),
        _count("verdict", "example").alias("n_example"),
        F.concat_ws(",", F.transform("found", lambda f: F.concat_ws(":", f["n_owners"].cast("string"), f["n_repositories"].cast("string")))).alias("carriers"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
