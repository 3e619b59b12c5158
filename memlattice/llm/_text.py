"""Whole texts as numpy arrays: word boundaries and 64-bit word hashes without a Python step per word.

A batch of texts becomes a UTF-8 buffer with offsets. Words are runs of anything but the six ASCII white
spaces. A word's hash is a polynomial in its bytes, taken from running sums, then mixed; it depends on the
bytes alone, so every executor gives the same word the same hash.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        if size > 1:
            out[1] = base
        k = 2
        while k < size:  # doubling: the second half is the first times base ** k
            out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if size > 4 * BLOCK:
            return out
        _powers[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of row groups with about `most` bytes, at least a row each. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    n = len(buf)
    word = np.zeros(n + 2, np.int8)
    word[1 : n + 1] = ~SPACE[buf]
    cut = offsets[1:-1]
    edge = np.diff(word)
    start, end = edge[:-1] == 1, edge[1:] == -1
    if len(cut):  # a text's end also ends a word
        cut = cut[(cut > 0) & (cut < n)]
        both = (word[cut] == 1) & (word[cut + 1] == 1)
        start[cut[both]] = True
        end[cut[both] - 1] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        a, b = int(starts[i]), int(ends[j - 1])
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * powers(_BASE, b - a)[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        h = (total[e] - total[s]) * powers(_INVERSE, b - a + 1)[s]
        out[i:j] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        i = j
    return out


def chained(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, in order."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * np.uint64(_BASE) + p)
    return h


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups that begin at first[:-1] and end at first[-1]; empty groups give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def code_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return per_text((buf & 0xC0) != 0x80, offsets)


class SortedTable:
    """Values by 64-bit hash, in two arrays ordered by hash."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.values = {k: v[order] for k, v in values.items()}
        self.nbytes = self.keys.nbytes + sum(v.nbytes for v in self.values.values())

    @staticmethod
    def find_in(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in sorted keys, and whether the key is there."""
        if not len(own):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(own, keys)
        at[at == len(own)] = 0
        return at, own[at] == keys

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.find_in(self.keys, keys)

    def get(self, name: str, keys: np.ndarray, default=0) -> np.ndarray:
        at, hit = self.find(keys)
        v = self.values[name]
        if not len(v):
            return np.full(len(keys), default, v.dtype)
        return np.where(hit, v[at], v.dtype.type(default))


class IdCache:
    """Ids of pieces of text by 64-bit hash, kept across batches and emptied when it holds `most` pieces."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def ids(self, hashes: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and where each piece's end. make: ids of the pieces at these indices, which are new."""
        keys, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == keys[inside]
            new = np.flatnonzero(~known)
            if len(new) and len(self.keys) and len(self.keys) + len(new) > self.most:
                self.clear()
                continue
            break
        if len(new):
            ids = make(one[new])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            begin = np.cumsum(size) - size + len(self.pool)
            self.pool = np.concatenate([self.pool, np.fromiter((x for y in ids for x in y), np.uint16, int(size.sum()))])
            place = at[new]
            self.keys, self.at, self.size = np.insert(self.keys, place, keys[new]), np.insert(self.at, place, begin), np.insert(self.size, place, size)
            at = np.searchsorted(self.keys, keys)
        begin, size = self.at[at][inverse], self.size[at][inverse]
        end = np.cumsum(size)
        return self.pool[np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], end


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Matrix products of this process run on one thread: a task has one core, and small products gain nothing from more."""
    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(handle := ctypes.CDLL(str(lib)), name):
                getattr(handle, name)(1)
                return


def trimmed(run):
    """run, a generator over batches, giving memory back to the system when a task has ended: a worker lives on for other stages."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Returns memory that a training has freed to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
