"""Bloom filters of bounded size, built by tasks and merged block by block.

A filter is ``bits`` bits (a power of two, at most ``MAX_BITS``: 32 MB), so
what is broadcast has a fixed bound. A fuller filter lets more keys through;
callers confirm exactly what passes, so results never depend on its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
BITS_PER_KEY = 8
PROBES = 3
BLOCK_BITS = 1 << 16


def filter_bits(keys: int) -> int:
    """Filter size for an exact number of keys, within the bounds."""
    need = max(1, keys) * BITS_PER_KEY
    return min(MAX_BITS, max(MIN_BITS, 1 << (need - 1).bit_length()))


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit positions of 64-bit keys."""
    keys = np.asarray(keys, dtype=np.uint64)
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([(keys + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def contains(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    if not len(keys):
        return np.zeros(0, bool)
    p = probes(keys, bits)
    return ((bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)


_PARTS = "block long, once binary, twice binary"


def _set(bitmap: np.ndarray, positions: np.ndarray) -> None:
    positions = np.unique(positions)
    if len(positions):
        byte = positions >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        bitmap[byte[first]] |= np.bitwise_or.reduceat((1 << (positions & 7)).astype(np.uint8), first)


def _parts(keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int):
    """A task's own once-seen and twice-seen filters, as bit positions per block."""
    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for keys in keys_of(batches):
            keys, n = np.unique(keys, return_counts=True)
            p = probes(keys, bits)
            _set(twice, p[:, contains(once, bits, keys) | (n > 1)])
            _set(once, p)
        width = BLOCK_BITS // 8
        for b in range(bits // BLOCK_BITS):
            seen = [np.flatnonzero(np.unpackbits(x[b * width:(b + 1) * width], bitorder="little")).astype(np.uint16).tobytes()
                    for x in (once, twice)]
            if seen[0]:
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array(seen[:1]), pa.array(seen[1:])], ["block", "once", "twice"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]):
    """Blocks of one filter: a bit is twice-seen if some task saw it twice or
    two tasks saw it. The rows of a block arrive together, sorted."""
    now, once, twice = None, None, None
    for batch in batches:
        for b, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != now:
                if now is not None:
                    yield _block(now, twice)
                now, once, twice = b, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
            twice[x[once[x]]] = True
            twice[y] = True
            once[x] = True
    if now is not None:
        yield _block(now, twice)


def _block(number: int, seen: np.ndarray) -> pa.RecordBatch:
    bits = np.packbits(seen, bitorder="little").tobytes()
    return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "bits": pa.array([bits], pa.binary())})


def _assemble(blocks: DataFrame, bits: int) -> bytes:
    """The filter's bytes on the driver: ``bits`` / 8 at most."""
    bitmap = np.zeros(bits // 8, np.uint8)
    width = BLOCK_BITS // 8
    for row in blocks.toLocalIterator():
        bitmap[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bitmap.tobytes()


def twice_seen(df: DataFrame, keys_of, bits: int) -> bytes:
    """Filter of the 64-bit keys that ``keys_of`` yields at least twice over
    all rows of ``df``. Each task fills a once-seen and a twice-seen filter;
    only set bits are shuffled, and the merge adds what two tasks saw."""
    parts = df.mapInArrow(_parts(keys_of, bits), _PARTS)
    merged = (parts.repartition("block").sortWithinPartitions("block")
              .mapInArrow(_merge, "block long, bits binary"))
    return _assemble(merged, bits)


def member_filter(keys: DataFrame, bits: int) -> bytes:
    """Filter of all 64-bit keys in the single long column of ``keys``."""
    def keys_twice(batches):
        for b in batches:
            yield np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 2)
    return twice_seen(keys, keys_twice, bits)


class Filter:
    """A broadcast filter of 64-bit keys."""

    def __init__(self, spark: SparkSession, bitmap: bytes, bits: int):
        self.bitmap, self.bits = spark.sparkContext.broadcast(bitmap), bits

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """Filter of all keys in the single long column of ``keys``."""
        bits = filter_bits(keys.agg(F.count("*")).first()[0])
        return cls(keys.sparkSession, member_filter(keys, bits), bits)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Which unsigned keys may be in it."""
        return contains(np.frombuffer(self.bitmap.value, np.uint8), self.bits, keys)
