"""Vectorised word and n-gram hashing over Arrow string buffers (no Python object for a word)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
#: Bytes of text that are worked on at a time, and so what bounds a worker's memory.
CHUNK_BYTES = 1 << 18
#: A word is a run of bytes other than space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODE = stream(11, 256)
PLACE_CODE = stream(23, 64) | U64(1)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            row = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


@lru_cache(maxsize=1)
def _trimmer():
    """The C library's call that gives freed memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of whole rows of about ``limit`` bytes."""
    data, at = buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


class Words:
    """The words of a chunk: ``start`` and ``end`` bytes, ``doc`` row in the chunk, ``hash``, ``bounds`` of each row's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        self.data = LOWER[data] if lower else data
        n = len(data)
        space = SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        self.start = np.flatnonzero(~space & (before | edge[:-1])) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets[1:], self.start, "right")
        self.bounds = np.searchsorted(self.start, offsets)
        up, down = powers(n + 1)
        self.prefix = np.zeros(n + 1, dtype=U64)
        if n:
            np.cumsum(BYTE_CODE[self.data] * up[:n], out=self.prefix[1:])
        self.down = down

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + U64(1))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.span_hash(self.start, self.end)
        return self._hash


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, over row borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:n] * PLACE_CODE[0]
    for j in range(1, k):
        out += hashes[j : j + n] * PLACE_CODE[j]
    return mix(out + U64(k))


def shingle_sets(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer words than k count as one shingle, no word gives an empty set."""
    every = grams(words.hash, k)
    for row in range(len(words.bounds) - 1):
        first, last = int(words.bounds[row]), int(words.bounds[row + 1])
        if last - first >= k:
            yield row, np.unique(every[first : last - k + 1])
        elif last > first:
            yield row, grams(words.hash[first:last], last - first)
        else:
            yield row, every[:0]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def map_whole(frame: DataFrame, work, schema) -> DataFrame:
    """``mapInArrow`` over all columns by place, as names with dots cannot be looked up."""
    return frame.toDF(*(f"c{k}" for k in range(len(frame.columns)))).mapInArrow(work, schema)
