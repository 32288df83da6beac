"""Secret redaction of strings and of whole nested rows."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The mask and the secret shapes, applied in this order.
MASK = "[REDACTED]"
SHAPES = [
    (r"(?i)https?://qyapi\.weixin\.qq\.com/[^\s\"')]*", f"https://qyapi.weixin.qq.com/{MASK}"),
    (r"(?i)https?://api\.telegram\.org/bot[^/\s\"')]+", f"https://api.telegram.org/bot{MASK}"),
    (r"(?i)https?://sctapi\.ftqq\.com/[^\s\"')]*", f"https://sctapi.ftqq.com/{MASK}"),
    (
        r"(?i)([?&](?:key|token|sendkey|access_token|apikey|api_key)=)[^&\s\"')]+",
        f"$1{MASK}",
    ),
    (r"\bre_[A-Za-z0-9_-]{12,}", MASK),
    (r"\bsk-[A-Za-z0-9_-]{12,}", MASK),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", MASK),
    (r"(?i)(\b[a-z][a-z0-9+.-]*://)[^/\s:@\"']+:[^/\s@\"']+@", f"$1{MASK}@"),
]


def _percent_encoded(value: str) -> str:
    return quote(value, safe="-_.!~*'()")


def redact(text: Column, secrets: list[str] | None = None) -> Column:
    """Mask known values, longest first, with their URL-encoded form; then the shapes."""
    out = text
    for value in sorted({s for s in secrets or [] if s}, key=len, reverse=True):
        for form in dict.fromkeys([value, _percent_encoded(value)]):
            out = F.replace(out, F.lit(form), F.lit(MASK))
    for pattern, mask in SHAPES:
        out = F.regexp_replace(out, pattern, mask)
    return out


def _redact_value(value: Column, kind: T.DataType, secrets: list[str] | None) -> Column:
    if isinstance(kind, T.StringType):
        return redact(value, secrets)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _redact_value(v, kind.elementType, secrets))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _redact_value(v, kind.valueType, secrets))
    if isinstance(kind, T.StructType):
        fields = [
            _redact_value(value.getField(f.name), f.dataType, secrets).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_rows(df: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """Redact every string anywhere in every row, following the schema."""
    return df.select(
        *[_redact_value(F.col(f"`{f.name}`"), f.dataType, secrets).alias(f.name) for f in df.schema.fields]
    )
