"""Array kernels shared by the text operators: word splitting and hashing on raw UTF-8.

A word is a run of bytes outside ``0x09-0x0D`` and ``0x20``, the same in every
operator. All functions work on whole texts; ``blocks`` only limits how many
documents one NumPy call sees at a time, never how much of a document.
Hashes are 64 bits: a polynomial over a byte table, finished by a mixer.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_EXACT = _rng.integers(0, 2**64, 256, dtype=U)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give memory that is free back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


_kept: dict[str, Callable[[], None]] = {}  # by operator: how to drop what it keeps in this process for its next task


def take_turn(operator: str = "", drop: Callable[[], None] | None = None) -> None:
    """A task of an operator starts in this process: what others kept for their next tasks goes. drop: how its own is to go."""
    if others := [x for x in _kept if x != operator]:
        for x in others:
            _kept.pop(x)()
        gc.collect()  # functions that were sent here hold themselves, and what they came with
        tidy()
    if drop:
        _kept[operator] = drop


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finisher on 64-bit values; salt gives independent ones."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


class Words:
    """Words of consecutive documents: byte spans, and for each document its first word."""

    __slots__ = ("data", "offsets", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~SPACE[data]
        head, tail = solid.copy(), solid.copy()
        head[1:] &= ~solid[:-1]
        tail[:-1] &= ~solid[1:]
        filled = offsets[1:] > offsets[:-1]
        at = offsets[:-1][filled]
        head[at] = solid[at]
        at = offsets[1:][filled] - 1
        tail[at] = solid[at]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: bool = False, salt: int = 0) -> np.ndarray:
        """One hash for each word; fold reads A-Z as a-z."""
        if not len(self.starts):
            return np.empty(0, U)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum((_FOLDED if fold else _EXACT)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts], salt)


def join_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours; the order counts."""
    return mix(a * U(0xD1342543DE82EF95) + b, 7)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.empty(0, U)
    parts, width, level, at = [], 1, h, k
    while at:
        if at & 1:
            parts.append((width, level))
        at >>= 1
        if at:
            level = join_pairs(level[:-width], level[width:])
            width *= 2
    n, out, done = len(h) - k + 1, None, 0
    for width, level in parts:
        piece = level[done : done + n]
        out = piece if out is None else join_pairs(out, piece)
        done += width
    return mix(out, k)


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of k words that lie in one document, and their documents."""
    counts = np.diff(first)
    per = np.maximum(counts - k + 1, 0)
    docs = np.repeat(np.arange(len(counts)), per)
    ahead = np.concatenate(([0], np.cumsum(per)))[:-1]
    return np.arange(per.sum()) + np.repeat(first[:-1] - ahead, per), docs


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string())
    if wide.null_count:
        wide = wide.fill_null("")
    _, offsets, data = wide.buffers()
    o = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    if data is None or o[-1] == o[0]:
        return np.empty(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows in groups of about size bytes of text (one row at least) with their words."""
    take_turn()
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
    tidy()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def grouped(owner: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the sorted owners 0..n-1."""
    return np.searchsorted(owner, np.arange(n + 1))
