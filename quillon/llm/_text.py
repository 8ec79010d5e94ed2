"""Vectorised text primitives: Arrow batches of documents to numpy arrays of words, lines and window hashes.

Everything here works on a bounded run of documents ("chunk"), so memory follows the chunk size and the
longest single document, never the table.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A document without an id orders after every document that has one.
NO_ID = np.iinfo(np.int64).max
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    if _POW.get("n", 0) < n:
        size = -(-n // (1 << 18)) << 18
        _POW["n"] = size
        for key, r in (("up", _R), ("down", _RINV)):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=np.uint64)
    return _POW["up"][:n], _POW["down"][:n]


class Prefix:
    """Polynomial prefix sums over a sequence of 64-bit codes; any span is hashed in O(1)."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:], dtype=np.uint64)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), the length included."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k codes, whatever document they cross."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


class Chunk:
    """Some whole documents: ids, and their texts as one array of UTF-8 bytes with offsets."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch):
        self.ids, self.data, self.offsets, self.rows = ids, data, offsets, rows

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk; ``doc`` is the position of a word's document in the chunk."""

    def __init__(self, chunk: Chunk, lower: bool):
        data, offsets = chunk.data, chunk.offsets
        solid = ~SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.solid = solid
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(chunk)), self.count)
        self.bytes = Prefix((LOWER_CODE if lower else BYTE_CODE)[data])
        self.hash = self.bytes.span(self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of k words that lie in one document."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = Prefix(self.hash).windows(k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :])
        return at, h[at]


def binary(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ints(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def trim() -> None:
    """Gives memory that is free back to the system; Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another libc has no such call
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], most: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> Iterator[Chunk]:
    """Cuts batches into runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = ints(batch.column(id_col))
        data, offsets = binary(batch.column(text_col))
        i, n = 0, len(ids)
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
            j = min(n, max(j, i + 1), i + 20_000)
            yield Chunk(ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.slice(i, j - i))
            i = j
    trim()


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of k that starts at one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
