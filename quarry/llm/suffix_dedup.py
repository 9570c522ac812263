"""Suffix-array dedup: repeated byte strings found from a prefix-free parse."""

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import pfp
from quarry.llm import repeats as R


class ParseParams(NamedTuple):
    width: int = 400
    #: bytes that the trigger hash sees, and one place in `every` triggers a phrase end
    window: int = 16
    every: int = 64
    #: starts that one record settles
    block: int = 128
    #: whether one of equal strings stays: that of the smallest doc_id, its first if several
    keep_one: bool = False
    #: edges of repeats with one core in one slice above which a few speak for all
    slice_edges: int = 16


def _units(data: np.ndarray, offs: np.ndarray) -> R.Units:
    return R.Units((K.byte_sums(data, 0), K.byte_sums(data, 1)), offs)


def triggers(sums: K.Sums, offs: np.ndarray, p: ParseParams) -> tuple[np.ndarray, np.ndarray]:
    """Places where the hash of the next `window` bytes ends a phrase, and the text of each."""
    h = sums.every(p.window)
    t = np.flatnonzero((h >> np.uint64(33)) % np.uint64(p.every) == 0)
    text = np.searchsorted(offs, t, "right") - 1
    inside = t + p.window <= offs[text + 1]
    return t[inside], text[inside]


def _blocks(p: ParseParams):
    """A window's anchor is its first trigger; the phrase before a trigger is cut into blocks by distance from it.
    Windows without a trigger (in long phrases) are blocks of their own."""
    reach = p.width - p.window

    def run(units: R.Units) -> tuple:
        one, two, offs = *units.sums, units.offs
        t, text = triggers(one, offs, p)
        begin, last = offs[text], offs[text + 1] - p.width
        before = np.where(np.diff(text, prepend=-1) == 0, np.concatenate(([0], t[:-1])), begin - 1)
        lo, hi = np.maximum(before + 1, t - reach + 1), np.minimum(t, last)
        parts = []
        for b in range(-(-reach // p.block)):
            s0, s1 = np.maximum(lo, t - (b + 1) * p.block + 1), np.minimum(hi, t - b * p.block)
            ok = s0 <= s1
            s0, s1, tt = s0[ok], s1[ok], t[ok]
            core = tt - b * p.block
            k = one.of(core, core - p.block + 1 + p.width) ^ np.uint64(b + 1)
            u = K.mix(two.of(s0, s1 + p.width) + ((tt - s0) * 4096 + (tt - s1)).astype(np.uint64))
            parts.append((text[ok], s0, s1, k, u))
        # what no trigger reaches: before a far one, after the last one, and whole texts without any
        gap0, gap1, gap_text = [before + 1], [np.minimum(t - reach, last)], [text]
        tail = np.full(len(offs) - 1, -1, np.int64)
        tail[text] = t
        gap0.append(np.maximum(tail + 1, offs[:-1]))
        gap1.append(offs[1:] - p.width)
        gap_text.append(np.arange(len(offs) - 1))
        g0, g1, gt = map(np.concatenate, (gap0, gap1, gap_text))
        s = K.spread(g0, g1)
        parts.append((np.repeat(gt, np.maximum(g1 - g0 + 1, 0)), s, s, one.of(s, s + p.width), two.of(s, s + p.width)))
        at, s0, s1, k, u = (np.concatenate(c) for c in zip(*parts, strict=True))
        return at, s0, s1, np.ones(len(at), bool), k, u

    return run


def _repeated(p: ParseParams):
    def run(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, _ = triggers(K.byte_sums(data, 0), offs, p)
        return pfp.repeated(data, pfp.corpus_order(data, offs, t, p.window, starts), p.width)

    return run


def remove_repeated_bytes(docs: DataFrame, params: ParseParams = ParseParams(), keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut from each text every byte covered by a `width`-byte string that also starts anywhere else; with keep_one, one of
    equal strings stays where it is.

    docs: doc_id, text; other columns are ignored. Returns one row for each row: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, and with keep_text also kept (what is left as text, without bytes of characters cut in two).
    Columns named in carry come along, so that no join has to bring them back.
    A null or empty text has no bytes. Rows repeated in full are texts of their own, so they remove each
    other; with keep_one they count as one text. Null doc_ids come back null. An empty table gives an empty result. A text may have
    up to 512 MB, and has to fit in a task.

    Phrases end where a rolling hash triggers, so equal strings are cut at equal places. Runs of phrases whose
    context is alone in the corpus, or repeats in full, are settled by hashes of that context. What is left,
    the edges of repeats, meets by its common core; there, suffix arrays of the dictionary of phrases and of the
    parse give the order of all suffixes, in which equal strings are neighbours.
    """
    scheme = R.Scheme(params.width, _units, _blocks(params), lambda data, keep: data[keep].tobytes(), R.ONE if params.keep_one else R.NONE, _repeated(params), params.slice_edges)
    done = R.remove_repeats(R.keyed(docs, carry), scheme, keep_text=keep_text)
    extra = [F.col("kept")] if keep_text else []
    return done.select(R.doc_id(), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), *extra, *R.carried(docs, carry))
