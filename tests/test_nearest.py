"""Clusters and nearest vectors by products of matrices, against plain numpy, with copies among vectors and centroids."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.plans import registry
from quarry.plans import tables as X

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def matrix(rows, column):
    return np.array([r[column] for r in rows], np.float64)


def nearest(x, c):
    size = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((c**2).sum(1))
    return np.round((x @ c.T) / size, 9).argmax(axis=1)


def test_ivf_build(spark):
    """The whole query; vectors meet centroids in tasks' matrices, not one by one in expressions of Spark."""
    v = sorted(X.vectors(spark, SF).collect(), key=lambda r: r["id"])
    x = matrix(v, "vector")
    seeds = sorted(I.seeds(X.vectors(spark, SF), I.cluster_count(len(v), 100)).collect(), key=lambda r: r["cluster_id"])
    c = matrix(seeds, "centroid")
    own = nearest(x, c)
    for i in range(len(c)):
        n = (own == i).sum()
        c[i] += max(0.01, n / (1 + n)) * (x[own == i].mean(axis=0) - c[i]) if n else 0
    own = nearest(x, c)
    found = registry.queries()["ivf_build"](spark, SF)
    assert {r["cluster_id"]: r["vectors"] for r in found.collect()} == {i: int((own == i).sum()) for i in range(len(c)) if (own == i).any()}
    assert "MapInArrow" in plan_of(found) and "zip_with" not in plan_of(found)


def test_copies_of_centroids_and_odd_vectors(spark):
    """Of equal centroids the lower id has all; null, zero and infinite vectors and those of another length go to the first."""
    x = np.random.default_rng(5).normal(size=(200, 8))
    c = np.concatenate([x[:20], x[:20], x[:20]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [1.0]), (203, [float("inf")] * 8), (204, [])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    centroids = spark.createDataFrame([(i + 3, p.tolist(), 1) for i, p in enumerate(c)], "cluster_id int, centroid array<double>, hits long")
    got = {r["id"]: r["cluster_id"] for r in I.assigned(v, centroids).collect()}
    assert [got[i] for i in range(200)] == (nearest(x, c) + 3).tolist() and all(got[i] == 3 for i in range(200, 205))
    moved = I.updated(v.where("id < 200 or id = 200"), centroids)
    own = nearest(x, c)
    for r in moved.collect():
        mine = own == r["cluster_id"] - 3
        assert r["hits"] == 1 + mine.sum()
        want = c[r["cluster_id"] - 3] + (mine.sum() / (1 + mine.sum()) * (x[mine].mean(axis=0) - c[r["cluster_id"] - 3]) if mine.any() else 0)
        assert np.allclose(r["centroid"], want)
    assert I.assigned(v, centroids.limit(0)).where(F.col("cluster_id").isNotNull()).count() == 0


def test_ivf_probe_in_blocks(spark, monkeypatch):
    """More queries than a block has, and several probes: the same rows as one by one in numpy; queries don't meet vectors in a join."""
    from quarry.operators import search as H

    monkeypatch.setattr(H, "BLOCK", 40)
    monkeypatch.setattr(H.in_blocks, "__defaults__", (40,))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8))
    x[300:400] = x[:100]
    c = np.concatenate([rng.normal(size=(6, 8)), x[:1], x[:1]])
    cluster = nearest(x, c)
    cluster[::10] = -1
    index = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, cluster, strict=True))] + [(900, None, 0), (901, [1.0], 1), (902, [0.5] * 8, None), (903, [0.5] * 8, 77)], "id long, vector array<double>, cluster_id int")
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, centroid array<double>")
    q = x[:100] + rng.normal(scale=0.1, size=(100, 8))
    q[:50] = x[:50]
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [("none", None), ("short", [1.0, 2.0])], "query_id string, vector array<double>")
    for probes in (1, 3, 8, 50):
        sim = np.round((q @ c.T) / np.sqrt((q**2).sum(1))[:, None] / np.sqrt((c**2).sum(1)), 9)
        chosen = np.argsort(-sim, axis=1, kind="stable")[:, :probes]
        want = set()
        for i in range(len(q)):
            rows = np.flatnonzero(np.isin(cluster, chosen[i]) | (cluster == -1))
            d = np.round(np.sqrt(((x[rows] - q[i]) ** 2).sum(1)), 9)
            want |= {(f"q{i}", r + 1, int(rows[j]), d[j]) for r, j in enumerate(np.lexsort((rows, d))[:5])}
        found = I.probed(index, centroids, asked, 5, probes)
        assert {(r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in found.collect()} == want
        assert "Join" not in plan_of(found)


def test_kept_vectors_are_one_file_a_cluster_and_told_as_one_set(spark, tmp_path):
    """Clusters of 20 vectors: a file for each; a search of all of them tells tasks one set of queries, not a list for each cluster."""
    from pathlib import Path

    from quarry.operators import vector_index as VI

    x = np.random.default_rng(7).normal(size=(800, 8)).astype(np.float32)
    rows = lambda ids: spark.createDataFrame([(i, x[i].tolist(), f"c{i % 2}") for i in ids], "id long, vector array<float>, collection string")
    path = str(tmp_path / "v")
    VI.create(rows(range(800)), path, VI.Sizes(per_cluster=20, least=50))
    c = VI.catalog(spark, path)
    assert len(c.number) == 40 and len(list(Path(path).rglob("vectors/gen=0/**/*.parquet"))) <= 40
    ids, points = None, x[:100].astype(float)
    for of, sets in (([None] * 100, 1), ([f"c{i % 2}" for i in range(100)], 2)):
        assert len(VI._asks(c, ids, points, of, 1 << 20).done()[-1]) == sets
    asked = rows(range(0, 800, 8)).withColumnRenamed("id", "query_id")
    for scoped in (False, True):
        found = VI.search(spark, path, asked if scoped else asked.drop("collection"), 5, 1 << 20).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["id"])
        for q in range(0, 800, 8):
            d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
            own = [i for i in np.argsort(d, kind="stable").tolist() if not scoped or i % 2 == q % 2]
            assert got[q] == own[:5]
