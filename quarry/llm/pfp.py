"""Prefix-free parsing: the order of a collection's suffixes from suffix arrays of its dictionary and its parse."""

import numpy as np

from quarry.llm import kernels as K


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the values of key; equal values have equal ranks."""
    order = np.argsort(key)
    new = np.ones(len(key), np.int64)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of each place's suffix up to the end of its own string: ends[i] is where the string of place i ends.

    Prefix doubling over all strings at once; symbols are from 1, an ended string sorts before all that go
    on, and equal suffixes have equal ranks.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    here, far, longest = np.arange(n), 1, int((ends - np.arange(n)).max())
    key = symbols.astype(np.int64)
    top = int(key.max()) + 1
    while top ** (far + 1) < 1 << 62 and far < longest:  # as many symbols as one key holds
        nxt = here + far
        key = key * top + np.where(nxt < ends, symbols[np.minimum(nxt, n - 1)], 0)
        far += 1
    rank = _dense(key)
    while far < longest:
        nxt = here + far
        rest = np.where(nxt < ends, rank[np.minimum(nxt, n - 1)], 0)
        rank = _dense(rank * (n + 1) + rest)
        far *= 2
    return rank


def parse(data: np.ndarray, offs: np.ndarray, triggers: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases as (begin, end, text): each begins at a text's start or a trigger and ends `window` bytes after the next one begins."""
    begin = np.unique(np.concatenate((offs[:-1][offs[:-1] < offs[1:]], triggers)))
    text = np.searchsorted(offs, begin, "right") - 1
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, offs[text + 1], np.append(begin[1:], 0) + window)
    return begin, np.minimum(end, offs[text + 1]), text


def corpus_order(data: np.ndarray, offs: np.ndarray, triggers: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """starts in the order of their suffixes (each up to the end of its text)."""
    if not len(starts):
        return starts
    begin, end, text = parse(data, offs, triggers, window)
    # dictionary: one copy of each distinct phrase, told apart by its bytes
    raw = data.tobytes()
    ids: dict[bytes, int] = {}
    # a phrase that its text's end cut short is another word than one that a trigger ended
    closed = np.append(text[1:] == text[:-1], False)
    phrase = np.array([ids.setdefault(raw[a:b] + (b"\1" if c else b"\0"), len(ids)) for a, b, c in zip(begin.tolist(), end.tolist(), closed.tolist(), strict=True)], np.int64)
    entries = [w[:-1] for w in ids]
    size = np.array([len(w) for w in entries], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    symbols = np.frombuffer(b"".join(entries), np.uint8).astype(np.int64) + 1
    inside = suffix_ranks(symbols, np.repeat(at[1:], size))
    # parse: phrases by their place in the dictionary's order
    place = inside[at[:-1]][phrase]
    stop = np.searchsorted(text, text, "right")
    after = suffix_ranks(place, stop)
    own = np.searchsorted(begin, starts, "right") - 1
    head = inside[at[:-1][phrase[own]] + starts - begin[own]]
    nxt = own + 1
    tail = np.where(nxt < stop[own], after[np.minimum(nxt, len(after) - 1)], 0)
    return starts[np.argsort(head * (len(after) + 2) + tail, kind="stable")]


def repeated(data: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Those starts, given in order, whose next `width` bytes equal a neighbour's, and a number for each set of equal ones."""
    if not len(order):
        return order, order
    same = np.zeros(len(order) + 1, bool)
    lanes = np.lib.stride_tricks.sliding_window_view(data, width)
    for i in range(0, len(order) - 1, 8192):
        a, b = order[i : i + 8192], order[i + 1 : i + 8193]
        same[i + 1 : i + 1 + len(b)] = (lanes[a[: len(b)]] == lanes[b]).all(axis=1)
    again = same[:-1] | same[1:]
    return order[again], np.cumsum(~same[:-1])[again]
