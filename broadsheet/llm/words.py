"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over its bytes, taken from one running sum over the column's
buffer and mixed at the end. Equal words have equal hashes in every task; different words
meet with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word lengthens its slice.
SLICE = 1 << 20
#: Odd and 5 modulo 8, so powers have the full period; the inverse undoes a shift.
BASE = 0x5DEECE66D2B79F35
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _lowered(letters: np.ndarray) -> np.ndarray:
    out = letters.copy()
    out[65:91] = letters[97:123]
    return out


#: What each byte adds to a hash; A-Z count as a-z.
LETTERS = _lowered(mix(np.arange(1, 257, dtype=np.uint64)))

#: True for bytes that end a word: white space, and ASCII that is no letter or digit.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64, n + 1, at * 8)
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str | int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text each, which bounds
    what a task holds at a time; a longer text is a run of its own."""
    for batch in batches:
        ends = buffers(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(column: pa.Array, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row where its words begin (n + 1 places)."""
    data, rows = buffers(column)
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = _cut(data, rows, breaks, lo + SLICE)
        found, at = _slice(data[lo:hi], rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi)] - lo, breaks)
        hashes.append(found)
        starts.append(at + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), rows)


def _cut(data: np.ndarray, rows: np.ndarray, breaks: np.ndarray, want: int) -> int:
    """The first place from ``want`` on that splits no word."""
    if want >= len(data):
        return len(data)
    row = int(rows[np.searchsorted(rows, want)])
    for lo in range(want, row, 4096):
        found = np.flatnonzero(breaks[data[lo : min(lo + 4096, row)]])
        if len(found):
            return lo + int(found[0])
    return row


def _slice(data: np.ndarray, rows: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~breaks[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[rows] = inside[rows]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = rows[rows > 0] - 1
    ends[before] = inside[before]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * power[: len(data)], out=total[1:])
    return mix((total[last + 1] - total[first]) * inverse[first]), first


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0][0]) < n:
        size = max(n, SLICE + 4096)
        _TABLES[:] = [(_powers(BASE, size), _powers(INVERSE, size))]
    return _TABLES[0]


def hash_texts(texts: list[str], breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a list."""
    return word_hashes(pa.array(texts, pa.string()), breaks)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` consecutive words from each place that has as many."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return mix(out)
