"""Bitmaps of bounded size over hashes: what was never set is surely absent, what is set may share its bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a hash that choose its bit: 8 MB a bitmap. By the number of keys, 128 KB to 64 MB.
BITS = 26
LEAST_BITS = 20
MOST_BITS = 29


def bits_for(keys: int) -> int:
    """Bits of a hash for a bitmap of so many keys: 64 bits a key up to ``BITS``, beyond that 16; a full bitmap holds back nothing, and
    each one lies on the disk of the driver and of every executor."""
    needed = lambda each: (each * keys - 1).bit_length() if keys else 0
    return min(MOST_BITS, max(LEAST_BITS, min(BITS, needed(64)), needed(16)))


def set_bits(hashes: Iterator[np.ndarray], size: int = BITS) -> Iterator[pa.RecordBatch]:
    """The bits of all hashes, as 64-bit words with their number (w int, bits long)."""
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    for x in hashes:
        at = x & np.uint64((1 << size) - 1)
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    at = np.flatnonzero(bits)
    for i in range(0, len(at), 50_000):
        some = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], names=["w", "bits"])


def has_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    at = hashes & np.uint64(64 * len(bits) - 1)
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def bitmap(rows: DataFrame, size: int = BITS) -> Broadcast:
    """The union of bits (w, bits) on all executors."""
    got = rows.groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)
