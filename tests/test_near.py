"""Near vectors in scopes and overlapping claims without comparing all with all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import near, queueing, semantic


def planted(rng, x, cosine):
    """A vector of each row's at the given cosine."""
    noise = rng.normal(size=x.shape)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return unit * cosine + noise * np.sqrt(1 - cosine**2)


@pytest.mark.parametrize(("least", "dim"), [(0.95, 32), (0.93, 64), (0.8, 48)])
def test_pairs_at_the_threshold_are_found_and_work_is_not_quadratic(spark, least, dim):
    """A scope with a third of all rows and 400 pairs just above the threshold, others in small scopes: recall 0.99 at least (all, as a rule), nothing below it, and of what is
    proposed fewer pairs than 20 times the rows."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1600, dim))
    other = planted(rng, base[:400], least + 0.004)
    below = planted(rng, base[400:500], least - 0.01)
    x = np.concatenate((base, other, below))
    scope = np.where(np.arange(len(x)) < 1600, np.where(np.arange(len(x)) % 3 == 1, [f"s{i % 200}" for i in range(len(x))], "hot"), "hot")
    scope[np.arange(1600, len(x))] = scope[np.arange(len(x) - 1600)]
    rows = spark.createDataFrame([(i, str(scope[i]), v.tolist()) for i, v in enumerate(x)], "id long, scope string, vector array<double>")
    got = {(r["a"], r["b"]): r["cosine"] for r in near.near_pairs(rows, least).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    true = {(i, j) for i, j in np.argwhere((c >= least) & (scope[:, None] == scope[None, :])).tolist() if i < j}
    assert set(got) <= true and len(got) >= 0.99 * len(true) and len(true) >= 400
    assert all(abs(got[p] - c[p]) < 1e-8 for p in got)
    n = int((scope == "hot").sum())
    bits, bands = near.shape(n, least)
    keys = near.codes(x[scope == "hot"], bits, bands)
    proposed = sum(int((np.unique(k, return_counts=True)[1] * (np.unique(k, return_counts=True)[1] - 1) // 2).sum()) for k in keys.T)
    assert proposed < bands * n and (least < 0.9 or proposed < 20 * len(x))


def test_shapes():
    """Bits grow with the scope, misses stay below what is stated."""
    for least in (0.8, 0.93, 0.95):
        for n in (65, 1000, 10**6, 10**9):
            bits, bands = near.shape(n, least)
            agree = 1 - np.arccos(least) / np.pi
            assert (1 - agree**bits) ** bands <= 1e-6 * 1.001 and bands <= 256
    assert near.shape(10**6, 0.95)[0] > near.shape(1000, 0.95)[0] > near.shape(65, 0.95)[0]


def test_odd_vectors_and_scopes(spark):
    """Null, zero, short and non-finite vectors, a null scope, equal vectors, and the same in scopes that are compared by codes."""
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", [0.0, 0.0]), (4, "a", None), (5, "a", [1.0]), (6, "a", [float("nan"), 1.0]), (7, None, [1.0, 0.0]), (8, "b", [1.0, 0.0]), (9, "a", [0.96, 0.28])]
    df = spark.createDataFrame(rows, "id long, scope string, vector array<double>")
    for p in (near.Bands(), near.Bands(small=1)):
        assert {(r["a"], r["b"], round(r["cosine"], 6)) for r in near.near_pairs(df, 0.95, p).collect()} == {(1, 2, 1.0), (1, 9, 0.96), (2, 9, 0.96)}
    assert near.near_pairs(df.limit(0), 0.95).count() == 0


def test_overlapping_claims(spark):
    """Against all pairs: files, folders, wildcards, the whole tree, equal claims, dots and slashes."""
    rng = random.Random(3)
    files = ["src/a.py", "src", "src/", "src/*", "src/lib/x.py", "src/lib/*", "*", "", "./src/a.py", "srcs/a.py", "src/a.py/", "lib//x", "lib/*.c", None]
    rows = [(f"s{i:02d}", rng.choice(["r1", "r2", None]), rng.choice(files)) for i in range(70)]
    df = spark.createDataFrame(rows, "session_id string, repo_root string, file string")
    based = {r["file"]: (r["g"]["prefix"], r["g"]["path"]) for r in df.select("file", queueing.glob_base(F.col("file")).alias("g")).distinct().collect()}
    inside = lambda child, base: base == "" or child == base or child.startswith(base + "/")
    want = []
    for sa, ra, fa in rows:
        for sb, rb, fb in rows:
            (pa, a), (pb, b) = based[fa], based[fb]
            if ra is not None and ra == rb and sa < sb and (a == b or (pa and inside(b, a)) or (pb and inside(a, b))):
                want.append((sa, sb, fa, fb))
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, queueing.overlaps(df).collect()), key=key) == sorted(want, key=key)


def test_targets_use_the_name_first(spark):
    known = spark.createDataFrame([(1, "f1", [1.0, 0.0]), (2, "f2", [0.0, 1.0]), (3, "f3", [0.0, 1.0])], "id long, file string, vector array<double>")
    new = spark.createDataFrame([(10, "f2", [1.0, 0.0]), (11, "x", [0.05, 1.0]), (12, "y", [-1.0, 0.0]), (13, "z", None)], "id long, file string, vector array<double>")
    assert {tuple(r) for r in semantic.write_targets(new, known).collect()} == {(10, "update", 2), (11, "update", 2), (12, "create", None), (13, "create", None)}


@pytest.mark.parametrize("least", [0.1, 0.25])
def test_low_thresholds_lose_no_pair(spark, least):
    """Where bands would propose most pairs, blocks compare all: equal to brute force over blocks of 50, a small scope, other lengths and copies; no digits are rounded away."""
    rng = np.random.default_rng(7)
    assert not near.sparse(least) and near.sparse(0.8)
    x = rng.normal(size=(420, 24))
    x[300:320] = x[:20] * 3
    x[320] = 0
    scope = np.where(np.arange(len(x)) < 350, "hot", "few")
    rows = [(f"r{i:03d}", str(scope[i]), v.tolist()) for i, v in enumerate(x)] + [(f"t{i}", "hot", [1.0, float(i)]) for i in range(5)] + [("u", "hot", None), ("v", "hot", []), ("w", None, [1.0])]
    vectors = {i: (s, np.array(v)) for i, s, v in rows if v and s and np.any(v)}
    want = {}
    for a, (sa, va) in vectors.items():
        for b, (sb, vb) in vectors.items():
            if a < b and sa == sb and len(va) == len(vb) and (c := va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb))) >= least:
                want[a, b] = c
    df = spark.createDataFrame(rows, "id string, scope string, vector array<double>")
    got = near.near_pairs(df, least, near.Bands(block=50), digits=None).collect()
    assert len(got) == len(want) > 1000 and {(r["a"], r["b"]) for r in got} == set(want)
    assert max(abs(r["cosine"] - want[r["a"], r["b"]]) for r in got) < 1e-12
    assert near.near_pairs(df.limit(0), least).count() == 0


def alike_records(spark, sf):
    from quarry.plans import more, tables

    own = {r["id"]: np.array(r["vector"], float) for r in more._vectors(spark, sf).collect()}
    rows = [r for r in tables.observations(spark, sf).select("id", "project_id", "branch", "session_id").collect() if r["id"] in own]
    return [(x, y, own[x["id"]] @ own[y["id"]] / (np.linalg.norm(own[x["id"]]) * np.linalg.norm(own[y["id"]]))) for x in rows for y in rows if x["project_id"] == y["project_id"]]


def test_scoped_pairs_are_of_the_records_own_vectors(spark):
    """All pairs of a project and branch with a cosine of 0.1, each record by its own vector: 150 at this scale."""
    from quarry.plans import registry

    sf = "/root/testdata/sf0.01"
    want = {(x["id"], y["id"]) for x, y, c in alike_records(spark, sf) if x["branch"] == y["branch"] and x["id"] < y["id"] and c >= 0.1}
    got = registry.queries()["scoped_cosine_pairs"](spark, sf).collect()
    assert len(got) == len(want) == 150 and {(r["a"], r["b"]) for r in got} == want


def test_overlaps_are_of_the_records_own_vectors(spark):
    """All pairs of claims of two sessions in a repository with a cosine of 0.25, each by its own vector: 40 at this scale."""
    from quarry.plans import registry

    sf = "/root/testdata/sf0.01"
    want = sorted((x["session_id"], y["session_id"], round(float(c), 6)) for x, y, c in alike_records(spark, sf) if x["session_id"] < y["session_id"] and round(c, 6) >= 0.25)
    got = sorted(map(tuple, registry.queries()["semantic_overlap"](spark, sf).collect()))
    assert got == want and len(got) == 40
