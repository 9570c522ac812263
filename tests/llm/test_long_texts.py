"""Texts above one slice (1 MiB), whole, with copies, a null id, a null and an empty text."""

import random

import numpy as np
import pytest

from quarry.llm import kernels as K
from quarry.llm import minhash_dedup, quality, substring_dedup, suffix_dedup, toxicity

from .conftest import by_row, sha, words
from .test_pairs import brute
from .test_repeats import brute_words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    pool = [f"w{a}{b}" for a in "abcdefgh" for b in range(60)]
    long, passage = words(rng, 250_000, pool), words(rng, 80, pool)
    near = long[:400_000] + " changed " + long[400_010:]
    out = [(1, long), (2, near), (3, long), (4, words(rng, 60, pool) + " " + passage), (5, long[600_000:601_500] + " end"), (None, passage), (6, None), (7, ""), (8, words(rng, 260_000, pool))]
    assert all(len(t.encode()) > K.SLICE_BYTES for i, t in out if i in (1, 2, 3, 8))
    return out


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words(long_docs, rows):
    assert by_row(substring_dedup.remove_repeated_words(long_docs).collect()) == by_row(brute_words(rows, 50))


def test_bytes(long_docs, rows):
    """By hashes of every window of each text, all told."""
    got = {(r["doc_id"]): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeated_bytes(long_docs).collect()}
    raw = [(i, np.frombuffer((t or "").encode(), np.uint8)) for i, t in rows]
    each = [K.byte_sums(b, 0).every(400) for _, b in raw]
    values, count = np.unique(np.concatenate(each), return_counts=True)
    for (i, b), h in zip(raw, each, strict=True):
        mark = np.zeros(len(b) + 1, int)
        at = np.flatnonzero(count[np.searchsorted(values, h)] > 1)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + 400, -1)
        gone = np.cumsum(mark)[:-1] > 0
        assert got[i] == (len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), sha(b[~gone].tobytes()))


def test_near_duplicates(long_docs, rows):
    got = minhash_dedup.near_duplicates(long_docs, minhash_dedup.SketchParams(shingle=2)).collect()
    assert by_row(got) == by_row(brute(rows, 2))


def test_scores_are_of_whole_texts(spark, long_docs, rows):
    """A toxic word behind the first slice counts, and a score is that of the text by itself."""
    p = toxicity.PUParams()
    text = rows[0][1] + " uniqueword"
    data = np.frombuffer(text.encode(), np.uint8)
    at, _ = toxicity.word_features(np.frombuffer(b"uniqueword", np.uint8), np.array([0, 10]), p)
    model = toxicity.Model(np.unique(at), np.full(len(np.unique(at)), 2.0), -3.0)
    df = spark.createDataFrame([(1, rows[0][1]), (2, text), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(df, model).collect()}
    one = toxicity.probability(model, data, np.array([0, len(data)]), p)[0]
    assert got[2] == one and got[2] > got[1] and got[3] < 0.1
    net = quality.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    q = {r["doc_id"]: r["quality_score"] for r in quality.score(df, net).collect()}
    assert set(q) == {1, 2, 3} and all(0 <= x <= 1 for x in q.values())
