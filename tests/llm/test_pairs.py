"""Near duplicates against brute force."""

import math
import re

import numpy as np

from quarry.llm import embedding_dedup, minhash_dedup
from quarry.llm.components import connected_components

from .conftest import by_row
from .test_repeats import split, thue_morse

LOW = -(1 << 63)


def labels(ids, links):
    """Smallest id of each row's component."""
    part = list(range(len(ids)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in links:
        part[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, d in enumerate(ids):
        low[top(i)] = min(d, low.get(top(i), d))
    return [low[top(i)] for i in range(len(ids))]


def brute(rows, size):
    ids = [LOW if d is None else d for d, _ in rows]
    sets = []
    for _, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    links += [(i, j) for i in range(len(rows)) for j in range(i) if rows[i] == rows[j] and sets[i]]
    comp = labels(ids, links)
    known = lambda x: None if x == LOW else x
    return [(known(d), len(s), known(c), c == d) for d, s, c in zip(ids, sets, comp)]


def test_minhash(docs, texts):
    for size in (2, 5):
        got = minhash_dedup.near_duplicates(docs, minhash_dedup.SketchParams(shingle=size)).collect()
        assert by_row(got) == by_row(brute(texts, size))


def test_minhash_in_chunks(docs, texts):
    """Groups dealt out as pairs of chunks give the same, here with two rows to a chunk."""
    got = minhash_dedup.near_duplicates(docs, minhash_dedup.SketchParams(shingle=2, chunk_rows=2)).collect()
    assert by_row(got) == by_row(brute(texts, 2))
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_words_that_agree_modulo_powers_of_two(spark):
    """Thue-Morse words and their complements agree in any polynomial hash modulo 2**64."""
    a, b = thue_morse(1024)
    rows = [(1, a), (2, b), (3, f"{a} x {a}"), (4, f"{b} x {b}"), (5, b.upper())]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash_dedup.SketchParams(shingle=2)).collect()
    assert by_row(got) == by_row(brute(rows, 2))


def test_links_need_equal_shingles():
    """Where hashes of shingles agree but words don't, there is no link."""
    h = np.arange(50, dtype=np.uint64)
    assert minhash_dedup.linked(np.array([3, 4]), [h, h], 80, lambda i, j: True) == ([3], [4])
    assert minhash_dedup.linked(np.array([3, 4]), [h, h], 80, lambda i, j: False) == ([], [])
    assert minhash_dedup.exact_set(b"a b c", 2) == {(b"a", b"b"), (b"b", b"c")} and minhash_dedup.exact_set(b"a", 2) == {(b"a",)} and not minhash_dedup.exact_set(b"", 2)


def test_minhash_recall_at_the_threshold(spark):
    """600 pairs of similarity 0.80 to 0.83: all are found (a miss is expected in 3e-7 of pairs at 0.8)."""
    rng = np.random.default_rng(12)
    rows, want = [], 0
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
        v = list(w)
        for k in rng.choice(147, 15, replace=False):
            v[2 * k + 1] = f"v{rng.integers(0, 10**9)}"
        sets = [{tuple(x[k : k + 2]) for k in range(299)} for x in (w, v)]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert 0.80 <= similarity <= 0.83
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash_dedup.SketchParams(shingle=2)).collect()}
    assert got == {i: i - i % 2 for i in range(1200)}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    h = np.concatenate((x[:300], x[100:400], x[:1]))
    s = minhash_dedup.sketch(h, np.array([0, 300, 600, 601, 601]), 448)
    assert (s[:3] != minhash_dedup._NONE).all() and (s[3] == minhash_dedup._NONE).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, list(map(float, b))) for i, b in enumerate(base)]
    rows += [(100 + i, list(map(float, base[3] + rng.normal(size=16) * 0.05))) for i in range(60)]
    rows += [(200, list(map(float, base[5]))), (201, list(map(float, base[5] * 1e200))), (202, list(map(float, -base[5])))]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [math.inf] + [1.0] * 15), (306, [1.0, 2.0]), (307, [1.0, 2.0]), (5, list(map(float, base[5])))]
    return rows


def test_embeddings(spark):
    rows = vectors()
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, n int")

    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    near = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and fine(rows[i][1]) and fine(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.95]
    comp = labels([i for i, _ in rows], near)
    want = [(r[0], sum(i == k for i, _ in near), c, c == r[0]) for k, (r, c) in enumerate(zip(rows, comp))]
    for p in (embedding_dedup.CodeParams(), embedding_dedup.CodeParams(chunk=16)):
        assert by_row(embedding_dedup.near_duplicates(d, p).collect()) == by_row(want)
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    """Estimates are right on average over rotations, and bounds hold."""
    rng = np.random.default_rng(3)
    u = embedding_dedup.unit(rng.normal(size=(200, 64)) + 2 * rng.normal(size=64))
    exact, off, errors = u @ u.T, ~np.eye(200, dtype=bool), []
    for seed in range(30):
        p = embedding_dedup.CodeParams(seed=seed)
        code, factor, error = embedding_dedup.coded(u, p)
        bound = embedding_dedup.upper(u, code, factor, error, p)
        errors.append((bound - error[None] - exact)[off].mean())
        assert (bound >= exact)[off].all() and ((bound - exact)[off] < 2 * error.max()).all() and (factor > 0.6).all()
    assert abs(np.mean(errors)) < 4 * np.std(errors) / 30**0.5 < 0.03


def test_embedding_recall_at_the_threshold(spark):
    """1,000 pairs of cosine 0.95 to 0.96 among unrelated vectors: all are found (a miss is expected in 6e-5 of pairs at 0.95)."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1000):
        a = embedding_dedup.unit(rng.normal(size=(1, 64)))[0]
        b = rng.normal(size=64)
        b = b - (a @ b) * a
        c = rng.uniform(0.9501, 0.96)
        b = c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (1, i - i % 2) for i in range(2000)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
