"""Bloom filters of bounded size over 64-bit hashes, built in tasks. They only spare rows: what they let through is still joined."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: bits that each hash sets
_PLACES = 3


def log2_for(n: int, bits: int, most: int) -> int:
    """log2 of the size of a filter with `bits` bits for each of n hashes, 2 ** most bits at most."""
    return min(most, int(np.ceil(np.log2(max(64, n * bits)))))


def _places(h: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    h, mask = K.mix(h), np.uint64((1 << log2) - 1)
    for i in range(_PLACES):
        yield (h >> np.uint64(17 * i)) & mask
        h = h * _STEP


def _cells(hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in hashes(batch):
                at = np.unique(np.concatenate(list(_places(h, log2))))
                cell, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(cell)), pa.array(K.signed(bits))], names=["cell", "bits"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch[c].to_numpy().tobytes()], pa.binary()) for c in ("cell", "bits")], names=["cells", "bits"])


def built(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int) -> tuple[np.ndarray, int]:
    """The filter of all hashes that `hashes` takes from the batches of rows; 2 ** log2 bits reach the driver, whatever the number of rows."""
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    cells = rows.mapInArrow(_cells(hashes, log2), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    for batch in cells.mapInArrow(_packed, "cells binary, bits binary").toLocalIterator():
        bits[np.frombuffer(batch["cells"], np.int64)] = np.frombuffer(batch["bits"], np.uint64)
    return bits, log2


def passing(h: np.ndarray, bits: np.ndarray, log2: int) -> np.ndarray:
    """Places of h (flat) that may be in the filter."""
    h = h.reshape(-1)
    left = np.arange(len(h))
    for i in range(_PLACES):
        at = next(x for j, x in enumerate(_places(h[left], log2)) if i == j)
        left = left[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return left
