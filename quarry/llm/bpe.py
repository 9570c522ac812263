"""Byte-level BPE: pieces found by a scan of transition functions, merged by rank, and decoded again.

A text is cut into pieces as the pattern of public_tokenizers.PATTERN cuts it, but without a regular expression: each code point becomes
a symbol (its class and a look at its neighbours), each symbol a function from state to state, and functions are composed block by
block, which is associative, so that all blocks of a slice advance together in numpy. Pieces are byte ranges of the slice; distinct
pieces are merged once for each worker.
"""

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.byte_pairs import merged
from quarry.functions.byte_pairs import table as ranks
from quarry.llm import kernels as K


class BpeParams(NamedTuple):
    #: a rank file: a line for each token, its bytes in base64 and its rank; where executors can't reach the path, ship the file and name it here
    path: str
    #: pieces whose ids a worker keeps; when there are more it forgets them all, which costs time only
    cache: int = 400_000


# Classes of code points.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Symbols: letter, number, other, an apostrophe before one or two letters of a contraction, white space before more of it or the
# end, a last space, another last white space; and all of these again for the first code point of a text.
A1, A2, INNER, LAST, LAST_OTHER, FIRST = 3, 4, 5, 6, 7, 8
# States: what was read last. CLOSED: nothing that could go on. C1, C2: in a contraction with so many letters to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_SPACE, C1, C2 = range(8)
#: code points for each of the blocks that advance together
_BLOCK = 512


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Next state by (symbol, state), and whether the code point begins a piece."""
    to, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for state in range(8):
        for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            to[symbol, state], begins[symbol, state] = own, state not in (own, AFTER_SPACE)
        for symbol, own in ((A1, C1), (A2, C2)):  # after others or a space it is one of the others
            joins = state in (IN_OTHERS, AFTER_SPACE)
            to[symbol, state], begins[symbol, state] = (IN_OTHERS, False) if joins else (own, True)
        to[INNER, state], begins[INNER, state] = IN_SPACE, state != IN_SPACE
        to[LAST, state], to[LAST_OTHER, state] = AFTER_SPACE, CLOSED
    to[LETTER, C1], begins[LETTER, C1] = CLOSED, False
    to[LETTER, C2], begins[LETTER, C2] = C1, False
    to[FIRST:] = to[:FIRST, CLOSED][:, None]  # whatever was before
    return to, begins


_TO, _BEGINS = _steps()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the tiktoken library (other libraries have other versions of Unicode)."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        one = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(one.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the place where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    more = np.diff(np.append(at, len(data))) - 1
    lead = data[at].astype(np.uint32)
    cp = np.where(more == 0, lead, lead & (0x3F >> more.clip(0, 3)))
    for i in range(1, 4):
        has = np.flatnonzero(more >= i)
        cp[has] = cp[has] << 6 | data[at[has] + i] & 0x3F
    return cp, at


def _symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A symbol for each code point; first marks those that begin a text."""
    n = len(cp)
    kind = _classes()[cp]
    ahead = np.full((2, n), 0, np.uint32)  # the two code points that follow in the text, else 0
    ahead[0, :-1] = np.where(first[1:], 0, cp[1:])
    ahead[1, :-1] = np.where(first[1:], 0, ahead[0, 1:])
    out = np.array([LETTER, NUMBER, OTHER, LAST_OTHER], np.uint8)[kind]
    quote = np.flatnonzero(cp == ord("'"))
    a, b = ahead[0, quote], ahead[1, quote]
    is_ = lambda x, y: (a == ord(x)) & (b == ord(y))
    out[quote[is_("r", "e") | is_("v", "e") | is_("l", "l")]] = A2
    out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = A1
    blank = kind == SPACE
    goes_on = np.ones(n, bool)
    goes_on[:-1] = blank[1:] | first[1:]
    out[blank & (cp == 32)] = LAST
    out[blank & goes_on] = INNER
    return out + FIRST * first.astype(np.uint8)


def begins(symbols: np.ndarray) -> np.ndarray:
    """Which code points begin a piece. Each block's symbols are composed into one function from its first state to its last; those
    functions give each block's first state, and with it all blocks run again side by side."""
    n = len(symbols)
    rows = -(-n // _BLOCK)
    grid = np.full(rows * _BLOCK, FIRST, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    flat = _TO.reshape(-1)
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for column in grid:
        f = flat[(column[:, None].astype(np.int32) << 3) | f]
    state = np.zeros(rows, np.int32)
    for i in range(1, rows):
        state[i] = f[i - 1, state[i - 1]]
    out, marks = np.empty((_BLOCK, rows), bool), _BEGINS.reshape(-1)
    for i, column in enumerate(grid):
        at = column.astype(np.int32) << 3 | state
        out[i] = marks[at]
        state = flat[at].astype(np.int32)
    return out.T.reshape(-1)[:n]


def pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of a slice begin (bytes), and its end. No piece spans two texts."""
    if not len(data):
        return np.zeros(1, np.int64)
    cp, at = code_points(data)
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    return np.append(at[begins(_symbols(cp, first[at]))], len(data))


#: bits of the table of pairs, and the odd number that spreads pairs over it
_SLOTS = 20
_MIX = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


@lru_cache(maxsize=4)
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash table of pairs of ids whose bytes together are a token: (keys, -1 where there is none; the ranks of keys;
    the id of each byte). A pair stands at the place that its hash names, or soon after without a gap."""
    have = ranks(path)
    found = [(left << 32 | right, r) for token, r in have.items() for i in range(1, len(token)) if (left := have.get(token[:i])) is not None and (right := have.get(token[i:])) is not None]
    key, rank = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int32)
    home = (key * _MIX) >> (64 - _SLOTS) & (1 << _SLOTS) - 1
    order = np.argsort(home, kind="stable")
    # in order of their first places each pair takes the first free place: 2 ** _SLOTS places and as many as stand over
    place = np.maximum.accumulate(home[order] - np.arange(len(order))) + np.arange(len(order)) if len(order) else order
    keys, to = np.full((1 << _SLOTS) + len(order) + 1, -1, np.int64), np.zeros((1 << _SLOTS) + len(order) + 1, np.int32)
    keys[place], to[place] = key[order], rank[order]
    return keys, to, np.array([have[bytes([i])] for i in range(256)], np.int32)


_NEVER = np.iinfo(np.int32).max


def merged_together(own: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """merged() of pieces of like length side by side: (ids of all, one after the other, and how many each has). A step makes one merge in each piece."""
    keys, to, byte = _pairs(path)
    size = np.array([len(x) for x in own])
    n, width = len(own), int(size.max())
    done = np.full((n, width), -1, np.int32)

    def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = (key * _MIX) >> (64 - _SLOTS) & (1 << _SLOTS) - 1
        more = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(more):  # taken by another pair: the next slot
            at[more] += 1
            more = more[(keys[at[more]] != key[more]) & (keys[at[more]] >= 0)]
        return np.where(keys[at] == key, to[at], _NEVER)

    ids = np.full((n, width), -1, np.int32)
    ids[np.arange(width) < size[:, None]] = byte[np.frombuffer(b"".join(own), np.uint8)]
    rank = np.full((n, width), _NEVER, np.int32)  # of each part and the next
    at, column = np.nonzero(ids[:, 1:] >= 0)
    rank[at, column] = rank_of(ids[at, column], ids[at, column + 1])
    live = np.arange(n)
    columns = np.arange(width)
    while True:
        j = rank.argmin(axis=1)
        row = np.arange(len(live))
        least = rank[row, j]
        go = least < _NEVER
        if not go.all():
            done[live[~go]] = ids[~go]
            live, ids, rank, j, least = live[go], ids[go], rank[go], j[go], least[go]
            row = np.arange(len(live))
        if not len(live):
            break
        second = columns[:-1] > j[:, None]  # all but the second of the two moves up
        ids[:, :-1], rank[:, :-1] = np.where(second, ids[:, 1:], ids[:, :-1]), np.where(second, rank[:, 1:], rank[:, :-1])
        ids[:, -1], rank[:, -1] = -1, _NEVER
        ids[row, j] = least
        rank[row, j] = _NEVER
        has = np.flatnonzero((j + 1 < width) & (ids[row, np.minimum(j + 1, width - 1)] >= 0))
        rank[has, j[has]] = rank_of(least[has], ids[has, j[has] + 1])
        has = np.flatnonzero(j > 0)
        rank[has, j[has] - 1] = rank_of(ids[has, j[has] - 1], least[has])
    there = done >= 0
    return done[there], there.sum(axis=1)


#: pieces of up to so many bytes are merged side by side, those of each range together; longer ones by themselves
_WIDTHS = (8, 16, 32, 64)


class _Cache(dict):
    """piece -> its number among the pieces seen, whose ids stand in one growing array."""

    def __init__(self, p: BpeParams):
        super().__init__()
        self.path, self.rank, self.most = p.path, ranks(p.path), p.cache
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n

    def merge(self) -> None:
        """Ids of the new pieces."""
        size = np.array([len(x) for x in self.new])
        whole = np.array([self.rank.get(x, -1) for x in self.new], np.int32)
        group = np.where(whole >= 0, -1, np.searchsorted(_WIDTHS, size))
        order, ids, count = [], [], []
        for g in np.unique(group):
            which = np.flatnonzero(group == g)
            own = [self.new[i] for i in which]
            if g < 0:
                got, many = whole[which], np.ones(len(which), np.int64)
            elif g < len(_WIDTHS):
                got, many = merged_together(own, self.path)
            else:
                each = [merged(x, self.rank) for x in own]
                got, many = np.array([y for x in each for y in x], np.int32), np.array([len(x) for x in each])
            order.append(which)
            ids.append(got)
            count.append(many)
        order, ids, count = map(np.concatenate, (order, ids, count))
        first = np.cumsum(count) - count
        back = np.argsort(order)
        self.ids = np.append(self.ids, ids[K.spread(first[back], (first + count - 1)[back])])
        self.offs = np.append(self.offs, self.offs[-1] + np.cumsum(count[back]))
        self.new = []

    def of(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        if len(self) > self.most:
            self.forget()
        b = bounds.tolist()
        which = np.fromiter(map(self.__getitem__, map(raw.__getitem__, map(slice, b, b[1:]))), np.int64, len(b) - 1)
        if self.new:
            self.merge()
        lo, hi = self.offs[which], self.offs[which + 1]
        return self.ids[K.spread(lo, hi - 1)], hi - lo


class Vocabulary:
    """The bytes of every token, end to end."""

    def __init__(self, path: str):
        have = ranks(path)
        size = max(have.values()) + 1
        tokens = [b""] * size
        for token, r in have.items():
            tokens[r] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.data[K.spread(self.first[ids], self.first[ids] + self.length[ids] - 1)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, pa.int32()))


def _encode(p: BpeParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(p)
        for batch in batches:
            for i, j, data, offs in K.slices(batch["text"]):
                bounds = pieces(data, offs)
                ids, count = cache.of(data.tobytes(), bounds)
                # tokens before each text: those of the pieces before it
                tokens = np.concatenate(([0], np.cumsum(count)))
                at = tokens[np.searchsorted(bounds, offs)] if len(data) else np.zeros(len(offs), np.int64)
                ends = np.cumsum(vocabulary(p.path).length[ids])
                ends -= np.repeat(offs[:-1], np.diff(at))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], pa.array(np.diff(at)), _lists(ids, at), _lists(ends, at)], names=["doc_id", "n_tokens", "ids", "ends"])

    return run


def encoded(docs: DataFrame, params: BpeParams) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids and ends, the place in the text's UTF-8 bytes where each token ends.

    Ids are those of the tiktoken library's encode_ordinary with the same ranks: strings of special tokens are ordinary text. A null or
    empty text has no tokens. Whole texts are encoded, one in a task (below 2 GB); a piece of n bytes takes time in proportion to n log n.
    Rows repeated in full and null ids come back as they are; other columns are left behind; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(params), f"doc_id {kind}, n_tokens long, ids array<int>, ends array<int>")


def _decode(p: BpeParams, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(p.path)
        for batch in batches:
            ids, n = batch["ids"], batch["ids"].value_lengths().fill_null(0).to_numpy()
            flat = ids.flatten().to_numpy()
            data, at = words.decode(flat), np.concatenate(([0], np.cumsum(n)))
            ends = np.concatenate(([0], np.cumsum(words.length[flat])))[at]
            raw = data.tobytes()
            texts = [raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(texts, pa.binary())], names=[*names, "bytes"])

    return run


def decoded(tokens: DataFrame, params: BpeParams) -> DataFrame:
    """tokens (ids, and other columns, which stay) with bytes: what the ids stand for. No ids, or null, give no bytes. A column `bytes` is replaced."""
    rest = [f for f in tokens.schema.fields if f.name != "bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", bytes binary"
    return tokens.select(*(f.name for f in rest)).mapInArrow(_decode(params, [f.name for f in rest]), schema)


def _digests(p: BpeParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decode(p, ["doc_id", "n_tokens", "ids"])(_encode(p)(batches)):
            ids = batch["ids"]
            raw, at = ids.flatten().to_numpy().astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))).tolist()
            packed = [sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            back = [sha256(x.as_buffer()).hexdigest() for x in batch["bytes"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], pa.array(packed, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, params: BpeParams) -> DataFrame:
    """What encoded and decoded give for docs (doc_id, text), as digests: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers)
    and decoded_sha256 (the bytes that the ids decode to). One Python worker a task does all three, so ids don't travel."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests(params), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
