"""Record types shared by every job. Nullable means "may be absent"."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, B, TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)
TEXTS = T.ArrayType(S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


SUMMARY_META = _struct(("by", S), ("model", S), ("prompt_version", S), ("input_kind", S))

ITEM = _struct(
    ("id", S, False),
    ("title", S, False),
    ("url", S),
    ("source", S, False),
    ("published_at", TS, False),
    ("score", D),
    ("author", S),
    ("excerpt", S),
)

ARCHIVED_ITEM = _struct(
    ("id", S),
    ("title", S),
    ("url", S),
    ("source", S),
    ("published_at", TS),
    ("score", D),
    ("author", S),
    ("excerpt", S),
    ("section", S),
    ("rank_score", D),
    ("summary", S),
    ("takeaways", TEXTS),
    ("summary_meta", SUMMARY_META),
)

DIGEST = _struct(("text", S), ("meta", SUMMARY_META))

ISSUE = _struct(
    ("date", S),
    ("slot", S),
    ("schedule_id", S),
    ("generated_at", TS),
    ("config_hash", S),
    ("timezone", S),
    ("lookback_hours", D),
    ("item_count", I),
    ("items", T.ArrayType(ARCHIVED_ITEM)),
    ("digest", DIGEST),
    ("warnings", TEXTS),
)

SOURCE = _struct(
    ("name", S, False),
    ("source_pos", I, False),
    ("type", S),
    ("weight", D),
    ("stale_after_days", I),
    ("strip_patterns", TEXTS),
    ("min_score", D),
    ("fetch_limit", I),
)

SECTION = _struct(
    ("id", S, False),
    ("section_pos", I, False),
    ("title", S),
    ("sources", TEXTS),
    ("limit", I),
    ("min_per_source", I),
    ("include", TEXTS),
    ("exclude", TEXTS),
    ("enabled", B),
)

AUDIENCE = _struct(
    ("id", S, False), ("channel", S), ("sections", TEXTS), ("format", S), ("detail", S)
)

POLICY = _struct(
    ("scope", S),
    ("key", S),
    ("summarize", B),
    ("style", S),
    ("language", S),
    ("max_chars", I),
    ("fetch_full_text", B),
)
