"""Words, hashes and shingles of texts inside tasks: bytes in, numpy arrays out.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``);
``bytes.lower`` lower-cases A-Z only, so other letters keep their case.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Distinct words whose hashes a worker remembers; the cache starts anew when it is full.
CACHED_WORDS = 120_000
#: Text bytes that a task holds as words at a time (a single longer text is held whole).
SLICE_BYTES = 4 << 20
#: Odd multiplier of the rolling hash, and the constants of its final mix.
STEP, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """word -> 64-bit hash, computed on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= STEP
        out += hashes[j : n + j]
    return mix(out)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased.

    With fewer than ``size`` words the whole sequence is the only shingle; a text
    without words has none.
    """
    hashes = word_hashes(text.lower().split())
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return mix(windows(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(windows(hashes, size))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def give_back() -> None:
    """Return what a finished task freed to the system, as Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def sum_range(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values[start:end]`` for each range; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]
