"""Sorted arrays in the shared folder: written by tasks, memory-mapped by workers.

A table of int64 keys with value columns is a list of files, each a sorted run of keys; the
files do not overlap. A file of a store that cannot be mapped is copied to an unlinked
temporary file first, so nothing stays behind on a worker.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyarrow import fs


@dataclass(frozen=True)
class Run:
    """A file: first key, number of rows, name, and the types of its columns, keys first."""

    first: int
    rows: int
    name: str
    types: tuple[str, ...]


def write(folder: str, columns: list[np.ndarray]) -> str:
    """Write one file below ``folder`` under a fresh name; it appears whole or not at all."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{root}/.{name}") as out:
        for column in columns:
            out.write(np.ascontiguousarray(column).view(np.uint8).data)
    store.move(f"{root}/.{name}", f"{root}/{name}")
    return name


def _mapped(folder: str, name: str) -> np.ndarray:
    store, root = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", np.uint8, "r")
    with tempfile.TemporaryFile() as copy:
        with store.open_input_stream(f"{root}/{name}") as source:
            shutil.copyfileobj(source, copy, 1 << 22)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")


class Sorted:
    """Runs in key order; rows are numbered through all of them."""

    def __init__(self, folder: str, runs: list[Run]):
        self.folder = folder
        self.runs = sorted((r for r in runs if r.rows), key=lambda r: r.first)
        self.firsts = np.array([r.first for r in self.runs], np.int64)
        self.starts = np.cumsum([0, *(r.rows for r in self.runs)])
        self.open: dict[int, list[np.ndarray]] = {}

    def _columns(self, i: int) -> list[np.ndarray]:
        if i not in self.open:
            run, data, at = self.runs[i], _mapped(self.folder, self.runs[i].name), 0
            self.open[i] = []
            for kind in run.types:
                width = np.dtype(kind).itemsize
                self.open[i].append(data[at : at + run.rows * width].view(kind))
                at += run.rows * width
        return self.open[i]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each of the ascending ``keys``, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        cuts = np.searchsorted(keys, self.firsts)
        for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(keys)])):
            if lo < hi:
                own = self._columns(i)[0]
                at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
                out[lo:hi] = np.where(own[at] == keys[lo:hi], at + self.starts[i], -1)
        return out

    def take(self, rows: np.ndarray, column: int) -> np.ndarray:
        """Values of a column at row numbers; -1 gives 0."""
        out = np.zeros(len(rows), np.float64 if self.runs and self.runs[0].types[column].startswith("f") else np.int64)
        run = np.searchsorted(self.starts, rows, side="right") - 1
        run[rows < 0] = -1
        for i in np.unique(run[run >= 0]):
            mine = run == i
            out[mine] = self._columns(i)[column][rows[mine] - self.starts[i]]
        return out
