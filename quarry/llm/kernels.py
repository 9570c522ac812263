"""numpy kernels over the bytes of many texts at once.

A slice is a run of whole texts laid end to end: `data` (uint8) and `offs` (int64, one more than texts).
Hashes are polynomials modulo the prime 2**61 - 1 at fixed random-looking points: with prefix sums of
symbol * BASE**i, the hash of any substring is a difference of two sums times an inverse power, so that every
substring costs O(1). Two different strings of n symbols agree at n of 2**61 points at most, whatever they are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
MIN_ID = -(1 << 63)

_U = np.uint64
_P = _U((1 << 61) - 1)
_61, _31, _30, _1 = _U(61), _U(31), _U(30), _U(1)
_LOW31, _LOW30 = _U((1 << 31) - 1), _U((1 << 30) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits; works on its own copy."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, list[np.ndarray]] = {}
#: units whose products with a limb of a power add up below 2**64
_LONGEST = 1 << 24
#: work goes in blocks that stay in the processor's cache
_BLOCK = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, up to one subtraction: below 2**61 + 8. In place."""
    high = x >> _61
    x &= _P
    x += high
    return x


def _times(a: np.ndarray, b1: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for a below 2**61 + 8 and b = b1 * 2**31 + b0."""
    a1, a0 = a >> _31, a & _LOW31
    mid = a1 * b0
    mid += a0 * b1
    a1 *= b1
    a1 <<= _1
    a0 *= b0
    a1 += a0
    a1 += mid >> _30
    mid &= _LOW30
    mid <<= _31
    a1 += mid
    return _reduced(a1)


def _least(x: np.ndarray) -> np.ndarray:
    """The one value below the prime of each."""
    x -= _P * (x >= _P)
    return x


def _power(lane: int, n: int) -> list[np.ndarray]:
    """High and low limbs of the powers of a lane's base and of their inverses; symbol sums use the former, differences the latter."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size, prime = max(n, 2 * len(have[0]) if have else 1 << 16), (1 << 61) - 1
        base, out = int(seeded(4, 4711)[lane] >> _U(4)) + 1000, []
        for b in (base, pow(base, -1, prime)):
            p = np.ones(size, _U)
            done = 1
            while done < size:  # doubling: the next powers are those so far times one
                step, m = pow(b, done, prime), min(done, size - done)
                p[done : done + m] = _least(_times(p[:m].copy(), _U(step >> 31), _U(step & ((1 << 31) - 1))))
                done += m
            out += [(p >> _31).astype(np.uint32), (p & _LOW31).astype(np.uint32)]
        _powers[lane] = have = out
    return have


class Sums:
    """Prefix sums over a sequence of symbols below 2**61; of(s, e) hashes symbols s..e-1 for arrays s and e. With
    small=True symbols are below 2**9."""

    def __init__(self, symbols: np.ndarray, lane: int, small: bool = False):
        n = len(symbols)
        p1, p0, *self.inverse = _power(lane, n + 1)
        self.high, self.low, self.small = np.zeros(n + 1, _U), np.zeros(n + 1, _U), small
        for i in range(0, n, _BLOCK):
            j = min(i + _BLOCK, n)
            v = symbols[i:j].astype(_U)
            if small:
                np.multiply(v, p1[i:j], out=self.high[i + 1 : j + 1])
                np.multiply(v, p0[i:j], out=self.low[i + 1 : j + 1])
            else:
                v = _least(_times(_reduced(v), p1[i:j], p0[i:j]))
                np.right_shift(v, _31, out=self.high[i + 1 : j + 1])
                np.bitwise_and(v, _LOW31, out=self.low[i + 1 : j + 1])
        # sums may pass 2**64; differences of up to _LONGEST units don't
        np.cumsum(self.high, out=self.high)
        np.cumsum(self.low, out=self.low)

    def _between(self, s, e) -> np.ndarray:
        high = _reduced(self.high[e] - self.high[s])
        low = _reduced(self.low[e] - self.low[s])
        low += high >> _30
        high &= _LOW30
        high <<= _31
        low += high
        return _reduced(low)

    def _done(self, v: np.ndarray, s) -> np.ndarray:
        return mix(_least(_reduced(_times(v, self.inverse[0][s], self.inverse[1][s]))))

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(s) and self.small and int((e - s).max()) > _LONGEST:
            v, at = np.zeros(len(s), _U), np.asarray(s)
            while (at < e).any():
                to = np.minimum(at + _LONGEST, e)
                v = _reduced(v + self._between(at, to))
                at = to
            return self._done(v, s)
        out = np.empty(len(s), _U)
        for i in range(0, len(s), _BLOCK):
            a, b = s[i : i + _BLOCK], e[i : i + _BLOCK]
            out[i : i + _BLOCK] = self._done(self._between(a, b), a)
        return out

    def every(self, width: int) -> np.ndarray:
        """The hash of each run of `width` symbols."""
        n = len(self.low) - width
        if n <= 0:
            return np.zeros(0, _U)
        out = np.empty(n, _U)
        for i in range(0, n, _BLOCK):
            j = min(i + _BLOCK, n)
            out[i:j] = self._done(self._between(slice(i, j), slice(i + width, j + width)), slice(i, j))
        return out


def byte_sums(data: np.ndarray, lane: int) -> Sums:
    return Sums(data + np.uint16(1), lane, small=True)


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Each run of `width` bytes, 8 at most, as a number: equal numbers are equal runs."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = data[:n].astype(_U)
    for i in range(1, width):
        out <<= _U(8)
        out |= data[i : n + i]
    return out


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each text's first word (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid
    ends[:-1] &= ~solid[1:] | first[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int = 0) -> np.ndarray:
    """A symbol, below 2**61, for each word."""
    return byte_sums(data, lane).of(s, e) >> _U(3)


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo..hi (ends included), one range after the other; empty where hi < lo."""
    n = np.maximum(hi - lo + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)


def as_bytes(column: pa.Array) -> pa.Array:
    """A text or binary column as large binary; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offs) of runs of whole texts of about `limit` bytes; one longer text is a run of its own."""
    arr = as_bytes(column)
    n = len(arr)
    if not n:
        return
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
