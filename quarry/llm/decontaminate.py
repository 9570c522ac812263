"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment."""

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.scratch import land


class GramParams(NamedTuple):
    q: int = 8
    #: edits allowed for each character (byte) of an item
    edits: float = 0.1
    #: items of fewer bytes are too short for edits
    least: int = 32
    #: whether those are looked for as they are, at borders of words; else they are in no text
    short: bool = False
    #: MB of items that go to every task at once, about half of it on average; more are searched for in turns
    block_mb: float = 32
    #: pairs of a text's and an item's gram that are counted at once
    pairs: int = 1 << 20
    #: log2 of the places in the table that most grams of a text are ruled out by
    log2_table: int = 22


class Short(NamedTuple):
    """The short items of one length, without white space around them."""

    hashes: np.ndarray  # sorted, and of each its item and bytes
    item: np.ndarray
    bytes: np.ndarray


class Items(NamedTuple):
    ids: np.ndarray
    texts: list[bytes]
    budget: np.ndarray  # edits of each
    need: np.ndarray  # q-grams that a text within the budget shares
    grams: np.ndarray  # sorted hashes of all q-grams, and of each its item and place
    item: np.ndarray
    place: np.ndarray
    width: int  # of half a band
    short: dict[int, Short]  # by length


_FOLD = K.lower(np.arange(256, dtype=np.uint8))
_FOLD[[9, 10, 11, 12, 13]] = 32


def folded(data: np.ndarray) -> np.ndarray:
    """Letters A-Z in lower case and all white space as spaces, byte by byte."""
    return _FOLD[data]


def index(ids: list[int], texts: list[bytes], p: GramParams) -> Items:
    texts = [folded(np.frombuffer(t, np.uint8)).tobytes() for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    # the q-gram lemma: k edits spoil k * q of m + 1 - q grams at most; a budget has to leave one
    budget = np.minimum((size * p.edits).astype(np.int64), np.maximum(size - p.q, 0) // p.q)
    offs = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = _hashes(data, p)
    at = np.arange(len(h))
    item = np.searchsorted(offs, at, "right") - 1
    ok = (at + p.q <= offs[item + 1]) & (size[item] >= p.least)
    h, at, item = h[ok], at[ok], item[ok]
    width = int(budget.max(initial=0)) + 1
    order = np.lexsort((at, item, h))
    h, item, place = _thinned(h[order], item[order], (at - offs[item])[order], width)
    return Items(np.array(ids, np.int64), texts, budget, size + 1 - p.q - p.q * budget, h, item, place, width, _short(texts, p))


def _hashes(data: np.ndarray, p: GramParams) -> np.ndarray:
    """A number for each q-gram: the gram itself, scrambled, if it has 8 bytes at most."""
    return K.mix(K.grams(data, p.q)) if p.q <= 8 else K.byte_sums(data, 0).every(p.q)


def _thinned(h: np.ndarray, item: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one gram's places in one item within each `width` bytes, two that meet a place of a text in all the bands that any of
    them does: the first and the last one there could be. A gram that an item repeats then has few places, and counts stay upper bounds."""
    part = place // width
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(h))) > 2
    stay = ~np.repeat(many, np.diff(np.append(begin, len(h))))
    b = begin[many]
    h, item, place = (np.concatenate((x[stay], y, z)) for x, y, z in ((h, h[b], h[b]), (item, item[b], item[b]), (place, part[b] * width, part[b] * width + width - 1)))
    order = np.argsort(h, kind="stable")
    return h[order], item[order], place[order]


def _short(texts: list[bytes], p: GramParams) -> dict[int, Short]:
    by_length: dict[int, list[tuple[int, bytes]]] = {}
    for i, t in enumerate(texts):
        bare = t.strip(b" ")
        if len(t) < p.least and bare:
            by_length.setdefault(len(bare), []).append((i, bare))
    out = {}
    for n, found in by_length.items():
        data = np.frombuffer(b"".join(t for _, t in found), np.uint8)
        at = np.arange(len(found)) * n
        h = K.byte_sums(data, 0).of(at, at + n)
        order = np.argsort(h, kind="stable")
        out[n] = Short(h[order], np.array([i for i, _ in found])[order], data.reshape(-1, n)[order])
    return out


@cache
def _joined() -> np.ndarray:
    """Whether a character (of the first plane) is part of a longer word if it stands beside another: letters, digits, their
    marks and _, but not of scripts that put no spaces between words (Thai, Lao, Myanmar, Khmer, and from U+2E80 on)."""
    out = np.zeros(1 << 16, bool)
    for c in (*range(0x0E00), *range(0x0F00, 0x1000), *range(0x10A0, 0x1780), *range(0x1800, 0x2E80)):
        out[c] = chr(c) == "_" or chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M"
    return out


def borders(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, and the end, of texts in UTF-8: whether no word goes on there. Ends of texts are borders."""
    out = np.ones(len(data) + 1, bool)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = np.concatenate((data, np.zeros(2, np.uint8))).astype(np.int64)
    first, two, three = b[at], b[at + 1] & 0x3F, b[at + 2] & 0x3F
    point = np.select([first < 0x80, first < 0xE0, first < 0xF0], [first, (first & 0x1F) << 6 | two, (first & 0x0F) << 12 | two << 6 | three], 0)
    word = np.zeros(len(data), bool)
    word[at] = _joined()[point]
    # bytes that begin no character belong to the one before
    owner = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
    word = word[owner]
    out[1:-1] = lead[1:] & ~(word[:-1] & word[1:])
    out[offs] = True
    return out


def short_matches(items: Items, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, 0, begin, end) of the short items that stand in a slice's folded texts between borders; the first place of each."""
    if not items.short or not len(data):
        return []
    border, sums = np.flatnonzero(borders(data, offs)), K.byte_sums(data, 0)
    is_border = np.zeros(len(data) + 1, bool)
    is_border[border] = True
    of = np.searchsorted(offs, border, "right") - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, s in items.short.items():
        inside = np.flatnonzero(border + n <= offs[np.minimum(of + 1, len(offs) - 1)])
        inside = inside[is_border[border[inside] + n]]
        at, text = border[inside], of[inside]
        h = sums.of(at, at + n)
        first, last = np.searchsorted(s.hashes, h, "left"), np.searchsorted(s.hashes, h, "right")
        hit = np.flatnonzero(first < last)
        row = K.spread(first[hit], last[hit] - 1)
        at, text = (np.repeat(x[hit], (last - first)[hit]) for x in (at, text))
        same = np.ones(len(at), bool)
        for k in range(n):
            same &= data[at + k] == s.bytes[row, k]
        at, text, item = at[same], text[same], s.item[row[same]]
        _, once = np.unique(text * len(items.ids) + item, return_index=True)
        for t, i, x in zip(text[once].tolist(), item[once].tolist(), (at - offs[text])[once].tolist(), strict=True):
            best[t, i] = (0, x, x + n)
    return [(t, i, *found) for (t, i), found in best.items()]


_FAR = 1 << 30


def alignments(item: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, cells: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band of `cells` diagonals from low on, in the text that data holds from begin to end: (edits, place in the text where it
    ends) of the item's best alignment with a part of the text, of equally good ones the first. More edits than the budget mean none.

    All bands go down the item together. Row i has one cell for each diagonal d, the text's place i + d, so no more than the band.
    """
    across = np.arange(cells)
    size = (end - begin)[:, None]
    at = low[:, None] + across  # places in the text of the row's cells
    row = np.where((at >= 0) & (at <= size), 0, _FAR)
    # the bytes that cells of row i compare with: place - 1; those outside of the text are none
    where = low[:, None] - 1 + np.arange(cells + len(item) + 1)
    seen = np.where((where >= 0) & (where < size), data[np.clip(begin[:, None] + where, 0, max(0, len(data) - 1))].astype(np.int16), -1)
    for i, c in enumerate(item.tolist()):
        at += 1
        new = row + (seen[:, i + 1 : i + 1 + cells] != c)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[(at < 0) | (at > size)] = _FAR
        first = at == 0
        if first.any():
            new[first] = i + 1
        row = np.minimum.accumulate(new - across, axis=1) + across
        if i % 16 == 15 and row.min() > budget:
            break
    best = row.argmin(axis=1)
    return row[np.arange(len(row)), best], at[np.arange(len(row)), best]


def banded(item: bytes, data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, width: int, budget: int, most: int = 1 << 18) -> np.ndarray:
    """(edits, begin, end) of the item within each band of diagonals low..low + width and what the budget adds, -1 for edits if
    there is none. Bands are aligned so many at once that their cells and bytes are `most` at most."""
    a = np.frombuffer(item, np.uint8)
    out = np.full((len(low), 3), -1, np.int64)
    cells = width + 2 * budget + 1
    step = max(1, most // (cells + len(a)))
    for i in range(0, len(low), step):
        one = slice(i, i + step)
        edits, stop = alignments(a, data, begin[one], end[one], low[one] - budget, cells, budget)
        hit = np.flatnonzero(edits <= budget) + i
        if not len(hit):
            continue
        edits, stop = edits[hit - i], stop[hit - i]
        # backwards from there: the item's reverse at diagonals around that of the end, in the reversed text
        whole = np.concatenate([data[b : b + n][::-1] for b, n in zip(begin[hit].tolist(), stop.tolist(), strict=True)]) if len(hit) else data[:0]
        offs = np.concatenate(([0], np.cumsum(stop)))
        back, length = alignments(a[::-1], whole, offs[:-1], offs[1:], np.full(len(hit), -budget), 2 * budget + 1, budget)
        out[hit] = np.stack((edits, np.where(back <= budget, stop - length, np.maximum(0, stop - len(a))), stop), axis=1)
    return out


def matches(items: Items, data: np.ndarray, offs: np.ndarray, table: np.ndarray, p: GramParams) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, begin, end) of all items in a slice's texts: of one item in one text, the best place."""
    data = folded(data)
    h = _hashes(data, p)
    may = np.flatnonzero(table[h >> np.uint64(64 - p.log2_table)])
    first = np.searchsorted(items.grams, h[may], "left")
    last = np.searchsorted(items.grams, h[may], "right")
    text = np.searchsorted(offs, may, "right") - 1
    ok = (first < last) & (may + p.q <= offs[text + 1])
    may, first, last, text = may[ok], first[ok], last[ok], text[ok]
    keys, count, lowest, span = _counts(items, may - offs[text], first, last, text, p)
    item_of = keys // span % max(1, len(items.ids))
    keep = count >= items.need[item_of]
    keys, item_of = keys[keep], item_of[keep]
    text_of, low = keys // span // max(1, len(items.ids)), (keys % span + lowest) * items.width
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in np.unique(item_of).tolist():
        own = np.flatnonzero(item_of == i)
        exact = np.zeros(len(own), bool)
        for t in np.unique(text_of[own]).tolist():
            at = data[offs[t] : offs[t + 1]].tobytes().find(items.texts[i])
            if at >= 0:
                best[t, i] = (0, at, at + len(items.texts[i]))
                exact |= text_of[own] == t
        own = own[~exact]
        t = text_of[own]
        for k, found in zip(t.tolist(), banded(items.texts[i], data, offs[t], offs[t + 1], low[own], 2 * items.width, int(items.budget[i])).tolist(), strict=True):
            if found[0] >= 0 and ((k, i) not in best or tuple(found) < best[k, i]):
                best[k, i] = tuple(found)
    return sorted([(t, i, *found) for (t, i), found in best.items()] + short_matches(items, data, offs))


def _counts(items: Items, at: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, p: GramParams) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keys, how many shared grams, lowest band, bands) for each text, item and band: key = (text * items + item) * bands + band - lowest.

    A diagonal lies in two bands, so that diagonals a budget apart share one. Pairs of grams are counted in bounded pieces.
    """
    lowest = -int(items.place.max(initial=0)) // items.width - 2
    span = int(at.max(initial=0)) // items.width - lowest + 2
    n = last - first
    ends = np.cumsum(n)
    parts, i = [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + p.pairs, "right")))
        gram = K.spread(first[i:j], last[i:j] - 1)
        band = (np.repeat(at[i:j], n[i:j]) - items.place[gram]) // items.width
        key = (np.repeat(text[i:j], n[i:j]) * len(items.ids) + items.item[gram]) * span + (band - lowest)
        parts.append(np.unique(np.concatenate((key, key - 1)), return_counts=True))
        i = j
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lowest, span
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64), lowest, span


def _blocks(benchmark: DataFrame, p: GramParams) -> Iterator[tuple[list[int], list[bytes]]]:
    """The items in blocks of bounded size, each fetched when it is asked for; which block an item is in goes by a hash."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(K.MIN_ID)).alias("item_id"), F.col("text").cast("string").cast("binary").alias("b")).where(F.octet_length("b") >= (1 if p.short else p.least))
    size = rows.agg(F.sum(F.octet_length("b").cast("long") + 64)).first()[0] or 0
    blocks = -(-2 * size // max(1, int(p.block_mb * (1 << 20)))) if size > p.block_mb * (1 << 20) else 1
    for block in range(blocks if size else 0):
        own = rows.where(F.pmod(F.xxhash64("item_id", "b"), F.lit(blocks)) == block).orderBy("item_id", "b").collect()
        if own:
            yield [r["item_id"] for r in own], [bytes(r["b"]) for r in own]


def _table(items: Items, p: GramParams) -> np.ndarray:
    table = np.zeros(1 << p.log2_table, bool)
    table[items.grams >> np.uint64(64 - p.log2_table)] = True
    return table


def contaminated(docs: DataFrame, benchmark: DataFrame, params: GramParams = GramParams()) -> DataFrame:
    """(doc_id, item_id, edits, begin, end) for each row of docs (doc_id, text) and item of benchmark (item_id, text) that its text holds.

    A text holds an item if some part of it is within edits * length edits of it, in bytes with A-Z in lower case and
    white space as spaces; begin and end are the part's bytes. Null and empty texts hold none; items of fewer than `least` bytes
    are in no text or, with `short`, in those where they stand without an edit, white space around them aside, and no word goes on
    before or behind. Null and blank ones are in none. Repeated rows and items give repeated rows. Null ids come back null. Documents aren't shuffled.
    No documents, or no items, give an empty result. Whole texts are searched, one in a task's memory.
    """
    p, out, shared = params, None, None
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(K.MIN_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, begin int, end int"
    for block in _blocks(benchmark, p):
        if out is not None:  # the blocks before are done with, so that the driver holds one at a time
            out = land(out, "contaminated")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = index(*shared.value, p)
            table = _table(items, p)
            for batch in batches:
                doc = batch["doc_id"].to_numpy()
                for i, _, data, offs in K.slices(batch["text"]):
                    got = np.array(matches(items, data, offs, table, p), np.int64).reshape(-1, 5)
                    if len(got):
                        yield pa.RecordBatch.from_arrays([pa.array(doc[i + got[:, 0]]), pa.array(items.ids[got[:, 1]]), *(pa.array(got[:, c].astype(np.int32)) for c in (2, 3, 4))], names=["doc_id", "item_id", "edits", "begin", "end"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = rows.select("doc_id", F.col("doc_id").alias("item_id"), *(F.lit(0).alias(c) for c in ("edits", "begin", "end"))).where(F.lit(False))
    known = lambda c: F.when(F.col(c) != F.lit(K.MIN_ID), F.col(c)).alias(c)
    return out.select(known("doc_id"), known("item_id"), "edits", "begin", "end")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, params: GramParams = GramParams()) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item of benchmark (see contaminated). Nothing is shuffled."""
    p = params
    shared = None
    for block in _blocks(benchmark, p):
        if shared is not None:
            docs = land(docs, "uncontaminated")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = index(*shared.value, p)
            table = _table(items, p)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, data, offs in K.slices(batch["text"]):
                    for t, *_ in matches(items, data, offs, table, p):
                        keep[i + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
