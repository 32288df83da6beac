"""Search of the archive by an index of three-letter runs.

The index holds, for each issue and for each item, the distinct runs of three letters of the
text that is searched, and is extended by new versions only. Texts are taken in blocks: a row of
the index is a run of a block with the places of the texts that have it, two bytes each, dealt to
folders by run; one more row of a block, in folders of its own, names the issues and items at these places.
So no row is made for a run of a text. A phrase's runs give the issues or items that have them all;
these few are read and compared with the phrase itself, so the results are those of
``views.search_issues`` and ``views.search_items``. A phrase of one or two letters has no run; it
is searched in all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import views
from broadsheet.session import materialize
from broadsheet.sources import sidetables
from broadsheet.sources.versions import read_committed

RUN = 3
# Named apart from indexes of one row for each run of a text, which earlier code left beside archives.
ISSUES, ITEMS = "issue_posts", "item_posts"
#: Texts of a block at most, so that two bytes hold a place; letters of a block, about.
BLOCK, LETTERS = 1 << 16, 1 << 20
#: Values that are numbered by a table of all of them; others are sorted.
TABLE = 1 << 24
#: Folders of the rows that name what is in a block, after those of the runs.
SHARES = 16
SCHEMA = "block STRING, run STRING, places BINARY, dates ARRAY<STRING>, slots ARRAY<STRING>, firsts ARRAY<INT>, counts ARRAY<INT>"


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 for the distinct values, all below ``size``, and these values."""
    if size > TABLE:
        found, at = np.unique(values, return_inverse=True)
        return at, found
    known = np.zeros(size, bool)
    known[values] = True
    return (np.cumsum(known) - 1)[values], np.flatnonzero(known)


def _posts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of the texts, the places of the texts that have each, run by run, and
    where the places of each run begin and end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    place = np.repeat(np.arange(len(texts)), sizes)
    letter, letters = _numbered(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), 0x110000)
    n = len(letters)
    whole = np.flatnonzero(place[: 1 - RUN] == place[RUN - 1 :])
    if not len(whole):
        return [], place[:0], np.zeros(1, np.int64)
    kind, kinds = _numbered((letter[whole] * n + letter[whole + 1]) * n + letter[whole + 2], n**RUN)
    pairs = np.sort(kind * len(texts) + place[whole])
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    ends = np.r_[0, np.cumsum(np.bincount(pairs // len(texts)))]
    spelled = letters[np.stack([kinds // n**2, kinds // n % n, kinds % n], 1)].astype("<u4").tobytes().decode("utf-32-le")
    return [spelled[i : i + RUN] for i in range(0, len(spelled), RUN)], pairs % len(texts), ends


def _block(texts: list[str], version: str, block: str, named: tuple) -> pa.RecordBatch | None:
    """The rows of a block; the last one names what is at its places."""
    runs, places, ends = _posts(texts)
    if not runs:
        return None
    data = [(2 * ends).astype("<i4").tobytes(), places.astype("<u2").tobytes()]
    posts = pa.Array.from_buffers(pa.binary(), len(runs), [None, *map(pa.py_buffer, data)])
    none = [None] * len(runs)
    kinds = [pa.list_(pa.string())] * 2 + [pa.list_(pa.int32())] * 2
    columns = [pa.array([x] * (len(runs) + 1)) for x in (version, block)]
    columns += [pa.array([*runs, None], pa.string()), pa.concat_arrays([posts, pa.nulls(1, pa.binary())])]
    columns += [pa.array([*none, values], kind) for values, kind in zip(named, kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["version", "block", "run", "places", "dates", "slots", "firsts", "counts"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index from issues with the texts of each."""
    for rows in batches:
        counts = rows.column("texts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [t or "" for t in rows.column("texts").flatten().to_pylist()]
        if not texts:
            continue
        version, date, slot, row = (rows.column(c).to_pylist() for c in ("version", "date", "slot", "row"))
        issue = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(texts)) - (np.cumsum(counts) - counts)[issue]
        letters = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        kinds = {v: k for k, v in enumerate(dict.fromkeys(version))}
        # A block ends where its places or its letters are spent, or another version begins.
        marks = (np.arange(len(texts)) // BLOCK, letters // LETTERS, np.array([kinds[v] for v in version])[issue])
        new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(texts)]):
            own, at, many = np.unique(issue[a:b], return_index=True, return_counts=True)
            named = ([date[i] for i in own], [slot[i] for i in own], pos[a + at].tolist(), many.tolist())
            made = _block(texts[a:b], version[own[0]], f"{row[own[0]]}.{pos[a]}", named)
            if made is not None:
                yield made


def _posted(issues: DataFrame, texts: Column) -> DataFrame:
    # The same part of a file always gives the same blocks, also when a task runs again.
    rows = issues.select("version", "date", "slot", F.monotonically_increasing_id().alias("row"), texts.alias("texts"))
    cut = rows.mapInArrow(_cut, f"version STRING, {SCHEMA}")
    share = F.lit(sidetables.BUCKETS) + F.pmod(F.crc32("block"), F.lit(SHARES)).cast("int")
    return cut.withColumn("bucket", F.coalesce(sidetables.bucket(F.col("run")), share))


def _issue_runs(issues: DataFrame) -> DataFrame:
    return _posted(issues, F.array(views.issue_text()))


def _item_runs(issues: DataFrame) -> DataFrame:
    return _posted(issues, F.coalesce(F.transform("items", views.item_text), F.array().cast("array<string>")))


def extend(spark: SparkSession, path: str) -> list[str]:
    """Add the versions that the indexes lack."""
    return sidetables.extend(spark, path, ISSUES, _issue_runs) + sidetables.extend(spark, path, ITEMS, _item_runs)


def _found(spark: SparkSession, path: str, name: str, phrase: str) -> DataFrame | None:
    """(version, date, slot, pos) of what has all runs of the phrase; None if it has none."""
    wanted = sorted({phrase[i : i + RUN] for i in range(len(phrase) - RUN + 1)})
    if not wanted:
        return None
    buckets = sorted({zlib.crc32(run.encode()) % sidetables.BUCKETS for run in wanted})
    shares = [sidetables.BUCKETS + k for k in range(SHARES)]
    rows = sidetables.stored(spark, path, name, SCHEMA, buckets + shares)

    def common(block: pa.Table) -> pa.Table:
        names = ["version", "date", "slot", "pos"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
        posts = [np.frombuffer(p, "<u2") for p in block.column("places").to_pylist() if p is not None]
        named = [r for r in block.select(["version", "dates", "slots", "firsts", "counts"]).to_pylist() if r["dates"] is not None]
        if len(posts) < len(wanted) or not named:
            return pa.table([pa.array([], k) for k in kinds], names)
        at = np.flatnonzero(np.bincount(np.concatenate(posts)) == len(wanted))
        own = named[0]
        ends = np.cumsum(own["counts"])
        issue = np.searchsorted(ends, at, "right")
        pos = np.array(own["firsts"])[issue] + at - (ends - own["counts"])[issue]
        values = [[own["version"]] * len(at), [own["dates"][i] for i in issue], [own["slots"][i] for i in issue], pos]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names)

    some = rows.where(F.col("run").isin(wanted) | F.col("run").isNull())
    found = some.groupBy("version", "block").applyInArrow(common, "version STRING, date STRING, slot STRING, pos INT")
    # Written, so that its size decides how the issues are read.
    return materialize(sidetables.of_live(spark, path, found), "found")


def search_issues(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """Issues whose date, slot, titles or sources contain the phrase, ignoring case."""
    extend(spark, path)
    found = _found(spark, path, ISSUES, phrase.strip().lower())
    live = None if found is None else found.select("date", "slot", "version").distinct()
    return views.search_issues(read_committed(spark, path, live=live), phrase)


def search_items(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """The matching items themselves."""
    extend(spark, path)
    found = _found(spark, path, ITEMS, phrase.strip().lower())
    if found is None:
        return views.search_items(read_committed(spark, path), phrase)
    # Only the issues of these items are read.
    some = read_committed(spark, path, live=found.select("date", "slot", "version").distinct())
    rows, found = views.search_items(some, phrase).alias("rows"), found.alias("found")
    same = (F.col("rows.date") == F.col("found.date")) & (F.col("rows.pos") == F.col("found.pos"))
    return rows.join(found, same & F.col("rows.slot").eqNullSafe(F.col("found.slot")), "left_semi")
