"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path prefix. A rule fits its host and all hosts below it if the
address's path begins with the rule's; of several, the longest wins. Addresses that no rule
fits are judged by trees trained on the labelled addresses, those that a rule fits (or any
other labels). The features are lengths, depth, share of digits, entropy of the letters,
numbers of parameters, hyphens and dots, a hint of a bare number as host, and the smoothed
share of blocked addresses under the host's suffix, from all labelled addresses.

Everything is built-in functions and the engine's own trees. The trees are trained on about
``BOUND`` labelled addresses, chosen by a hash. Suffix shares are grouped aggregates; they
join back by suffix, where a frequent one is split at run time.

Null addresses and those without ``://`` have an empty host and path and fit no rule; they
are judged by their features like others. Without labels of both kinds the method allows.
Every row gives one row; other columns are kept, columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import materialize
from broadsheet.sources.tables import table

BOUND = 50_000
ROUNDS, DEPTH = 12, 3
SMOOTH = 20.0

#: The rules of the registered query.
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = [
    "length",
    "host_length",
    "path_length",
    "depth",
    "host_labels",
    "digit_share",
    "entropy",
    "parameters",
    "hyphens",
    "longest_part",
    "number_host",
    "fragment",
    "suffix_share",
]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        where, prefix = rule.split("/", 1)
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + prefix)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _number_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a letter, from how often each different letter occurs."""
    size = F.length(text).cast("double")
    letters = F.array_distinct(F.split(text, ""))
    share = F.transform(
        F.filter(letters, lambda c: c != ""),
        lambda c: (size - F.length(F.replace(text, c)).cast("double")) / size,
    )
    return F.when(size > 0, F.aggregate(share, F.lit(0.0), lambda n, p: n - p * F.log2(p))).otherwise(0.0)


def featured(urls: DataFrame, url: str) -> DataFrame:
    """``urls`` with all features but ``suffix_share``, and ``_suffix``."""
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    size = F.length(text).cast("double")
    query_ = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": size,
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": _number_of(path, "/[^/]"),
            "host_labels": _number_of(host, r"[^.]+"),
            "digit_share": F.when(size > 0, _number_of(text, "[0-9]") / size).otherwise(0.0),
            "entropy": _entropy(text),
            "parameters": _number_of(query_, "[^&=]+=?[^&]*"),
            "hyphens": _number_of(host, "-"),
            "longest_part": F.aggregate(F.split(path, "[/._-]"), F.lit(0.0), lambda n, p: F.greatest(n, F.length(p).cast("double"))),
            "number_host": host.rlike(r"^[0-9.]+(:[0-9]+)?$").cast("double"),
            "fragment": F.contains(text, F.lit("#")).cast("double"),
            "_suffix": F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -1),
        }
    )


def judged(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id", label: Column | None = None) -> DataFrame:
    """``urls`` with host, path, rule, verdict and block_chance (null where a rule decides).

    ``label`` is block, allow or null; by default the labels are the rules' verdicts.
    """
    rows = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_says": says})
    rows = rows.withColumn("_label", F.when((F.col("_says") if label is None else label) == "block", 1.0).when((F.col("_says") if label is None else label) == "allow", 0.0))
    rows = materialize(featured(rows, url), "urls")
    labelled = rows.filter(F.col("_label").isNotNull())
    known = labelled.agg(F.count("_label"), F.sum("_label")).first()
    total, blocked = known[0], known[1] or 0.0
    drop = [*FEATURES, "_suffix", "_says", "_label"]
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "block_chance", *drop)]
    out = [*kept, "host", "path", "rule"]
    if not 0 < blocked < total:
        return rows.select(*out, F.coalesce("_says", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(0.0)).alias("block_chance"))
    shares = labelled.groupBy("_suffix").agg(((F.sum("_label") + SMOOTH * blocked / total) / (F.count("_label") + SMOOTH)).alias("suffix_share"))
    rows = rows.join(materialize(shares, "suffixes"), "_suffix", "left").fillna(blocked / total, ["suffix_share"])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
    share = min(1.0, BOUND / total)
    chosen = vectors.filter(F.col("_label").isNotNull() & (F.pmod(F.xxhash64(key, url), F.lit(1_000_000)) < int(share * 1_000_000)))
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=ROUNDS, maxDepth=DEPTH, seed=5, predictionCol="_class")
    trees = trees.setProbabilityCol("_chances").setRawPredictionCol("_raw")
    model = trees.fit(chosen.select("_features", "_label"))
    found = model.transform(vectors).withColumn("_chance", vector_to_array("_chances")[1])
    method = F.when(F.col("_chance") >= 0.5, "block").otherwise("allow")
    return found.select(*out, F.coalesce("_says", method).alias("verdict"), F.when(F.col("rule").isNull(), F.round("_chance", 9)).alias("block_chance"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "block_chance")
