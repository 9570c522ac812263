"""Substring dedup: maximal exact repeats of words found from fixed-block anchors."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import repeats as R


class AnchorParams(NamedTuple):
    width: int = 50
    #: words in a reference block; any window of 2 * block - 1 words holds a whole one
    block: int = 25
    #: bits for each indexed block in the filter that spares probes, and its greatest size: 2**29 bits are 64 MB
    filter_bits: int = 24
    filter_log2_most: int = 29
    #: edges of repeats with one core in one slice above which a few speak for all
    slice_edges: int = 16


def _units(data: np.ndarray, offs: np.ndarray) -> R.Units:
    s, e, woffs = K.words(data, offs)
    # lanes of their own from the bytes on
    return R.Units((K.Sums(K.word_hashes(data, s, e, 0), 2), K.Sums(K.word_hashes(data, s, e, 1), 3)), woffs)


def _join(data: np.ndarray, keep: np.ndarray) -> bytes:
    s, e, _ = K.words(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return b" ".join(raw[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True))


def _reach(units: R.Units, p: AnchorParams, at: np.ndarray, text: np.ndarray):
    """First and last start of the windows that hold the block at `at` as their first whole block."""
    lo = np.maximum(units.offs[text], at - p.block + 1)
    hi = np.minimum(at, units.offs[text + 1] - p.width)
    return lo, hi


def _own(units: R.Units, p: AnchorParams) -> tuple[np.ndarray, np.ndarray]:
    """The non-overlapping blocks of each text, and the text of each."""
    n = np.diff(units.offs)
    count = np.maximum(n // p.block, 0)
    text = np.repeat(np.arange(len(n)), count)
    at = units.offs[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * p.block
    lo, hi = _reach(units, p, at, text)
    return at[lo <= hi], text[lo <= hi]


def _place(k: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(log2)
    return k >> (np.uint64(64) - bits), (k >> np.uint64(8)) & np.uint64((1 << log2) - 1)


def _index(p: AnchorParams, log2: int):
    """The filter's set bits, 64 to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in K.slices(batch["text"]):
                units = _units(data, offs)
                at, _ = _own(units, p)
                both = np.unique(np.concatenate(_place(units.sums[0].of(at, at + p.block), log2)))
                if len(both):
                    cell, first = np.unique(both >> np.uint64(6), return_index=True)
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (both & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(cell)), pa.array(K.signed(bits))], names=["cell", "bits"])

    return run


def _blocks(p: AnchorParams, shared, log2: int):
    """Reference blocks, and every rolling window that may equal one: a block record for each."""

    def run(units: R.Units) -> tuple:
        bits = shared.value
        all_k = units.sums[0].every(p.block)
        a, b = _place(all_k, log2)
        six, mask = np.uint64(6), np.uint64(63)
        may = (bits[a >> six] >> (a & mask)) & (bits[b >> six] >> (b & mask)) & np.uint64(1)
        probe = np.flatnonzero(may)
        text = np.searchsorted(units.offs, probe, "right") - 1
        ok = probe + p.block <= units.offs[text + 1]
        probe, text = probe[ok], text[ok]
        ref = (probe - units.offs[text]) % p.block == 0
        lo, hi = _reach(units, p, probe, text)
        ok = lo <= hi
        probe, text, ref, lo, hi = probe[ok], text[ok], ref[ok], lo[ok], hi[ok]
        u = K.mix(units.sums[1].of(lo, hi + p.width) + ((probe - lo) * 4096 + (probe - hi)).astype(np.uint64))
        k = all_k[probe]
        # neighbours of equal content (one word over and over) make one record
        apart = np.ones(len(k), bool)
        apart[1:] = (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (text[1:] != text[:-1]) | (probe[1:] != probe[:-1] + 1)
        first = np.flatnonzero(apart)
        if not len(first):
            return text, lo, hi, ref, k, u
        return text[first], lo[first], np.maximum.reduceat(hi, first), np.logical_or.reduceat(ref, first), k[first], u[first]

    return run


def block_filter(docs: DataFrame, p: AnchorParams) -> tuple[np.ndarray, int]:
    """A Bloom filter over all reference blocks, of bounded size; it only spares probes that can't hit."""
    n = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(16, int(np.ceil(np.log2(max(1, n / 6 / p.block * p.filter_bits)))))
    log2 = min(p.filter_log2_most, wanted)
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    cells = docs.mapInArrow(_index(p, log2), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    for batch in cells.mapInArrow(_packed, "cells binary, bits binary").toLocalIterator():
        bits[np.frombuffer(batch["cells"], np.int64)] = np.frombuffer(batch["bits"], np.uint64)
    return bits, log2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch[c].to_numpy().tobytes()], pa.binary()) for c in ("cell", "bits")], names=["cells", "bits"])


def remove_repeated_words(docs: DataFrame, params: AnchorParams = AnchorParams(), keep_text: bool = False) -> DataFrame:
    """Cut from each text every word covered by a `width`-word window that also starts in a text of smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns one row for each row: doc_id, n_words, n_removed,
    kept_sha256 (the kept words joined by one space), and with keep_text also kept (what is left as text, without bytes of characters cut in two).
    A null text or one without words has none. A null doc_id counts as smaller than all others. Rows of one
    doc_id don't remove each other's words. An empty table gives an empty result. A text has to fit in a task.

    Non-overlapping blocks of each text are indexed; every rolling window of a block's length probes the
    index; around each hit, the words on either side are compared to extend it as far as texts agree.
    """
    keyed = R.keyed(docs)
    bits, log2 = block_filter(keyed, params)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    scheme = R.Scheme(params.width, _units, _blocks(params, shared, log2), _join, R.FIRST, slice_edges=params.slice_edges)
    done = R.remove_repeats(keyed, scheme, keep_text=keep_text)
    extra = [F.col("kept")] if keep_text else []
    return done.select(R.doc_id(), F.col("n_units").alias("n_words"), "n_removed", F.col("sha").alias("kept_sha256"), *extra)
