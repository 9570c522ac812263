"""Substring operators against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import kernels as K
from quarry.llm import pfp, repeats, substring_dedup, suffix_dedup

from .conftest import by_row, sha

SPACE = " \t\n\x0b\x0c\r"


def split(t):
    for c in SPACE:
        t = (t or "").replace(c, " ")
    return [w for w in t.split(" ") if w]


def removed(n, starts, width):
    gone = [False] * n
    for i in starts:
        gone[i : i + width] = [True] * width
    return gone


def brute_bytes(rows, w, keep_one=False):
    """With keep_one, rows are told apart by id and text."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + w] for _, b in rows for i in range(len(b) - w + 1))
    low = {}
    for d, b in rows:
        for i in range(len(b) - w + 1):
            me = (-(1 << 63) if d is None else d, b, i)
            low[b[i : i + w]] = min(me, low.get(b[i : i + w], me))
    out = []
    for d, b in rows:
        goes = lambda i: low[b[i : i + w]] != (-(1 << 63) if d is None else d, b, i) if keep_one else seen[b[i : i + w]] > 1  # noqa: E731, B023
        gone = removed(len(b), [i for i in range(len(b) - w + 1) if goes(i)], w)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def brute_words(rows, w):
    rows = [(-(1 << 63) if d is None else d, split(t)) for d, t in rows]
    low = {}
    for d, ws in rows:
        for i in range(len(ws) - w + 1):
            low[tuple(ws[i : i + w])] = min(d, low.get(tuple(ws[i : i + w]), d))
    out = []
    for d, ws in rows:
        gone = removed(len(ws), [i for i in range(len(ws) - w + 1) if low[tuple(ws[i : i + w])] < d], w)
        out.append((None if d < -(1 << 62) else d, len(ws), sum(gone), sha(" ".join(x for x, g in zip(ws, gone) if not g))))
    return out


@pytest.mark.parametrize("group", [repeats.ORDER_GROUP, 0])
def test_bytes(docs, texts, monkeypatch, group):
    """Both ways for the edges of repeats: corpus order, and hashes as for large groups."""
    monkeypatch.setattr(repeats, "ORDER_GROUP", group)
    got = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert by_row(got) == by_row(brute_bytes(texts, 400))


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("group", [repeats.ORDER_GROUP, 0])
def test_one_stays(docs, texts, monkeypatch, group, few):
    """Ids are distinct here but for rows of null and 61, whose ties go by a hash."""
    monkeypatch.setattr(repeats, "ORDER_GROUP", group)
    texts = [(i, t) for i, t in texts if i is not None]
    p = suffix_dedup.ParseParams(width=250, keep_one=True, slice_edges=few)
    got = suffix_dedup.remove_repeated_bytes(docs.where("doc_id is not null"), p).collect()
    assert by_row(got) == by_row(brute_bytes(texts, 250, keep_one=True))


@pytest.mark.parametrize("few", [0, 1])
def test_many_edges(docs, texts, few):
    """Where a few edges of a slice speak for all, nothing is lost."""
    assert by_row(suffix_dedup.remove_repeated_bytes(docs, suffix_dedup.ParseParams(slice_edges=few)).collect()) == by_row(brute_bytes(texts, 400))
    p = substring_dedup.AnchorParams(slice_edges=few)
    for d in (docs, docs.coalesce(1)):
        assert by_row(substring_dedup.remove_repeated_words(d, p).collect()) == by_row(brute_words(texts, 50))


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_strings_that_agree_modulo_powers_of_two(spark):
    """Thue-Morse strings and their complements agree in any polynomial hash modulo 2**64; they share no long string."""
    a, b = thue_morse(2048)
    rows = [(1, a), (2, b), (3, " ".join([a[:1024]] * 60)), (4, " ".join([b[:1024]] * 60))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(suffix_dedup.remove_repeated_bytes(d).collect()) == by_row(brute_bytes(rows, 400))
    assert by_row(substring_dedup.remove_repeated_words(d).collect()) == by_row(brute_words(rows, 50))


def test_rows_of_one_id_whose_hashes_agree(spark, monkeypatch):
    """Rows without an id are told apart though 32 bits of their texts' hashes agree."""
    rng = np.random.default_rng(6)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120))
    copied, alone = text(), text()
    rows = [(None, copied), (None, copied + " x"), (None, alone), (7, alone[:300])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    real = repeats.row_key
    monkeypatch.setattr(repeats, "row_key", lambda: [real()[0], F.lit(0).alias("t2")])
    assert by_row(suffix_dedup.remove_repeated_bytes(d).collect()) == by_row(brute_bytes(rows, 400))
    assert by_row(substring_dedup.remove_repeated_words(d).collect()) == by_row(brute_words(rows, 50))


def test_words(docs, texts):
    assert by_row(substring_dedup.remove_repeated_words(docs).collect()) == by_row(brute_words(texts, 50))


def test_words_with_a_full_filter(docs, texts):
    """A filter that rules out nothing only costs probes."""
    p = substring_dedup.AnchorParams(filter_log2_most=16, filter_bits=0)
    assert by_row(substring_dedup.remove_repeated_words(docs, p).collect()) == by_row(brute_words(texts, 50))


def test_empty(docs):
    none = docs.limit(0)
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert substring_dedup.remove_repeated_words(none).count() == 0


def test_kept_text_is_valid(spark):
    body = "é" * 200
    d = spark.createDataFrame([(1, "x" + body), (2, "yy" + body + "z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in suffix_dedup.remove_repeated_bytes(d, keep_text=True).collect()}
    assert got == {1: ("x", 400), 2: ("yyz", 400)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6))
def test_corpus_order(parts):
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    p = suffix_dedup.ParseParams(width=6, window=3, every=2)
    t, _ = suffix_dedup.triggers(K.byte_sums(data, 0), offs, p) if len(data) > 3 else (np.zeros(0, np.int64), None)
    starts = np.arange(len(data))
    order = pfp.corpus_order(data, offs, t, p.window, starts)
    ends = offs[np.searchsorted(offs, order, "right")]
    suffixes = [data[a:b].tobytes() for a, b in zip(order, ends)]
    assert suffixes == sorted(suffixes)
