"""Bit arrays of a fixed size that tell which keys can't be in a set, however large the set is: what is broadcast has a
size of its own, not the set's. A key passes by chance the more often the larger the set is; what passes is joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits that a key sets.
BITS = 3


def places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of a filter of ``size`` bytes (a power of two) that 64-bit hashes set."""
    return [(h >> np.uint64(20 * i)) & np.uint64(8 * size - 1) for i in range(BITS)]


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The numbers of the hashes that pass."""
    at = np.arange(len(h))
    for i in range(BITS):
        place = places(h[at], len(bits))[i]
        at = at[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def built(hashes: DataFrame, size: int) -> bytes:
    """The filter of the hashes in the first column (BIGINT). Put together in blocks of 64 KB on the executors; ``size``
    bytes reach the driver."""
    block = min(1 << 16, size)

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint8)
        for part in parts:
            for place in places(part.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(held, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        used = [b for b in range(size // block) if held[b * block : (b + 1) * block].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([held[b * block : (b + 1) * block].tobytes() for b in used], pa.binary())], ["b", "bits"])

    def join(group: pa.Table) -> pa.Table:
        return pa.table({"b": group["b"][:1], "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"].to_pylist()]).tobytes()], pa.binary())})

    out = bytearray(size)
    for row in hashes.mapInArrow(mark, "b bigint, bits binary").groupBy("b").applyInArrow(join, "b bigint, bits binary").collect():
        out[row.b * block : (row.b + 1) * block] = row.bits
    return bytes(out)
