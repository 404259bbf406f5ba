"""Bit tables of fixed size over 64-bit keys: what passes one may be among the keys, what does not is none of them.

They keep a shuffled join from moving rows that cannot match. Their size is a parameter, not a share of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bit_table(keys: DataFrame, log: int) -> np.ndarray:
    """A table of 2 ** log bits with one set for each key (column ``key``): merged by stretches of the table, so its
    fixed size is all that reaches a task or the driver."""
    stretch = 1 << 15

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << log, dtype=bool)
        for b in batches:
            own[_bit_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), log)] = True
        packed = np.packbits(own)
        some = [k for k in range(0, len(packed), stretch) if packed[k : k + stretch].any()]
        for k in some:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed[k : k + stretch].tobytes()])], ["at", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(bits, np.uint8)
                held[k] = held[k] | new if k in held else new
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits.tobytes()])], ["at", "bits"])

    out = np.zeros((1 << log) // 8, dtype=np.uint8)
    for k, bits in keys.select("key").mapInArrow(partial, "at long, bits binary").repartition("at").mapInArrow(merge, "at long, bits binary").collect():
        out[k : k + len(bits)] |= np.frombuffer(bits, np.uint8)
    return out


def _bit_of(keys: np.ndarray, log: int) -> np.ndarray:
    return (keys >> np.uint64(64 - log)).astype(np.int64)


def passing(packed: np.ndarray, keys: np.ndarray, log: int) -> np.ndarray:
    at = _bit_of(keys, log)
    return np.flatnonzero(packed[at >> 3] & (128 >> (at & 7)).astype(np.uint8))
