"""Sorted hashes as compressed bytes, for exchanges that would have too many rows.

A batch (some megabytes of text) sends one packed row to each part of the hash space
instead of a row for each hash, and holds a hash once however often the batch has it.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of one batch, on average.
BATCH_BYTES = 3 << 20


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers: differences, byte by byte, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = steps.view(np.uint8).reshape(-1, values.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(planes.T.copy().view(kind).ravel(), dtype=kind)


def pack_plain(values: np.ndarray) -> bytes:
    """Numbers in any order."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_plain(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return planes.T.copy().view(kind).ravel()


def part_cuts(keys: np.ndarray, bits: int, width: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of ascending keys, whose part is what stands above their low ``width`` bits; empty parts are left out."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width))
    ends = [*cuts.tolist(), len(keys)]
    return [(part, begin, end) for part, (begin, end) in enumerate(zip([0, *ends], ends)) if end > begin]


def part_bits(numbers: int, each: int = 2_000_000, least: int = 6) -> int:
    """Bits that name a part, so that a part gets about ``each`` of so many numbers; ``least`` at least."""
    return max(least, int(np.ceil(np.log2(max(1, numbers / each)))))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
