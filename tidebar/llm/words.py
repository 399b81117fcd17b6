"""Words of many texts at once, as flat numpy arrays.

Tasks hand over Arrow batches; cutting and hashing words one text at a time in
Python would dominate every operator here, so a whole slice of a batch is cut
with a handful of vector operations over its UTF-8 buffer.

Null texts count as empty: they have no words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def frugal(run):
    """A map over batches that returns freed memory to the system at its end, as idle workers keep what they once had."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return mapped


#: Bytes of text that are cut into words at a time; bounds a task's arrays.
SLICE_BYTES = 2 << 20
_LONG_WORD = 256
_WORDS_AT_ONCE = 1 << 17
#: (seed, two odd factors) of the first and of the second hash of words.
_HASH = [(0x9E3779B97F4A7C15, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93), (0x2545F4914F6CDD1D, 0xC2B2AE3D27D4EB4F, 0x9DDFEA08EB382D69)]


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: ``[^\x20\x09-\x0D]+``: runs of anything but ASCII white space.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text: ASCII letters and digits, and all beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's begin (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of ``len(offsets) - 1`` texts: word i is ``data[start[i]:end[i]]``; text d has words ``offsets[d]:offsets[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands; ``second``: by a hash that has nothing of the first."""
        n = len(self.start)
        out = np.empty(n, np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        for a in range(0, n, _WORDS_AT_ONCE):
            out[a : a + _WORDS_AT_ONCE] = self._hashes(eight, slice(a, a + _WORDS_AT_ONCE), *_HASH[second])
        return out

    def _hashes(self, eight: np.ndarray, part: slice, seed: int, first: int, then: int) -> np.ndarray:
        start, end = self.start[part], self.end[part]
        size = end - start
        h = np.full(len(size), seed, dtype=np.uint64)
        left, at, live = size.copy(), start.copy(), None
        long = np.flatnonzero(size > _LONG_WORD)
        left[long] = 0
        while True:
            live = np.flatnonzero(left > 0) if live is None else live[left[live] > 0]
            if not len(live):
                break
            rest = np.minimum(left[live], 8).astype(np.uint64)
            piece = eight[at[live]] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (rest << U64(3))))
            x = (h[live] ^ piece) * U64(first)
            x ^= x >> U64(29)
            h[live] = x * U64(then)
            left[live] -= 8
            at[live] += 8
        for i in long:
            digest = hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(digest, "little")
        return mix64(h ^ size.astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def cut(column, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Cuts each text of a string column into its words."""
    return cut_bytes(*utf8(column), table, lower)


def cut_bytes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay in one text, and the word each starts at."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = U64((0xA0761D6478BD642F + 2 * seed * 0xE7037ED1A0B428DB) % 2**64 | 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= base
        h += hashes[k : k + n]
    whole = np.ones(n, bool)
    for k in range(1, size):  # a run may not reach over the end of its text
        edge = offsets[1:-1] - k
        edge = edge[(edge >= 0) & (edge < n)]
        whole[edge] = False
    at = np.flatnonzero(whole)
    return mix64(h[at] + U64(size)), at
