"""SetSketch registers of shingle sets in numpy, and their joint estimate by likelihood.

A register holds the least of ``-log(uniform)`` over a set's elements on a scale of powers of
``STEP``, cut to 0..TOP. The sketch of a union is the larger of two registers, place by
place, and the chance that two registers agree is about the sets' Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from broadsheet.llm.words import BASE, mix, runs

REGISTERS = 128
BANDS = 32
PLACES = 4096
#: Distance and number of the scale's powers, and the rate of the exponential values.
STEP = 1.001
TOP = (1 << 16) - 1
RATE = 20.0
_KEYS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its distinct ``size``-word shingles, sorted; fewer words are one shingle."""
    whole = runs(hashes, size)
    out = []
    for start, end in zip(rows[:-1], rows[1:]):
        if end - start >= size:
            out.append(np.unique(whole[start : end - size + 1]))
        elif end > start:
            out.append(runs(hashes[start:end], int(end - start)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set; empty sets have zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    least = np.empty((len(full), REGISTERS), np.uint64)
    done = 0
    while done < len(full):  # some sets at a time, so that their elements stay in the cache
        end, n = done, 0
        while end < len(full) and (end == done or n + len(sets[full[end]]) <= 1 << 15):
            n += len(sets[full[end]])
            end += 1
        part = [sets[i] for i in full[done:end]]
        flat = np.concatenate(part)
        starts = np.cumsum([0, *map(len, part[:-1])])
        for j in range(REGISTERS):
            least[done:end, j] = np.minimum.reduceat((flat ^ _KEYS[2 * j]) * _KEYS[2 * j + 1], starts)
        done = end
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(value) / np.log(STEP)), 0, TOP)
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """BANDS numbers for each sketch; two sketches share one where a band's registers agree."""
    n = REGISTERS // BANDS
    parts = sketches.astype(np.uint64).reshape(len(sketches), BANDS, n)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(n):
        out = mix(out * np.uint64(BASE) + parts[:, :, k])
    return out


def parity(values: np.ndarray) -> np.ndarray:
    """Whether the number of elements at each of PLACES places is odd, packed. The parities of
    two sets differ in at most as many bits as the sets do in elements."""
    return np.packbits(np.bincount((values % np.uint64(PLACES)).astype(np.int64), minlength=PLACES) & 1)


def _power(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (STEP - 1) / STEP) / np.log(STEP)


def likelihoods(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log likelihood of each Jaccard similarity of ``grid`` for each pair of sketches, from how
    often the first, the second or neither register is larger; the sets' sizes are known."""
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (sizes_a / (sizes_a + sizes_b))[:, None]
    v = 1 - u
    likely = np.minimum(grid[None, :], np.minimum(u / v, v / u))
    more, less = _power(u - v * likely), _power(v - u * likely)
    same = np.clip(1 - more - less, 1e-12, 1)
    return up * np.log(more) + down * np.log(less) + (REGISTERS - up - down) * np.log(same)


GRID = np.arange(0, 101) / 100


def may_reach(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, least: float, doubt: float = 20.0) -> np.ndarray:
    """False for pairs whose similarity is below ``least`` beyond doubt: the best estimate is
    smaller and ``exp(doubt)`` times as likely as the likeliest value from ``least`` on."""
    grid = np.r_[GRID[GRID < least], least, GRID[GRID > least]]
    scores = likelihoods(a, b, sizes_a, sizes_b, grid)
    return scores.max(axis=1) - scores[:, grid >= least].max(axis=1) <= doubt
