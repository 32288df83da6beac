"""Small tables with the rows that break things."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", "s", "ing", "."]) for _ in range(words))


def rows(*texts) -> list[tuple]:
    return [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]


ODD = [None, "", " ", "\n\n", "A", "é", "x " * 3, "日本語 テキスト", "a" * 5000, "\x00 nul", "…!?", "😀 emoji", "Ä ä A a"]


def frame(spark, data, schema: str = SCHEMA):
    return spark.createDataFrame(data, T.DataType.fromDDL(schema) if isinstance(schema, str) else schema)


def odd(spark):
    """Odd texts, a repeated row, nulls in every column, and a very long text."""
    data = rows(*ODD, prose(1, 40), prose(1, 40), prose(2, 30_000))
    data += [data[13], (None, "no id " * 8, None, None, None), (None, None, None, None, None)]
    return frame(spark, data)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
