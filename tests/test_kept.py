"""Kept indexes: what is read and written, changes that break, and the same rows as searches from scratch."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import keyword_index as KI
from quarry.operators import search as H
from quarry.operators import vector_index as VI

LAY = KI.Layout(buckets=8, block=3, shard=10)
TEXTS = ["the red fox", "a red red hen", "the blue fox and the fox", None, "", "Étude fox_2", "hen hen hen hen", "the the the the the"] + [f"filler{i % 4} the word{i}" for i in range(40)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


QUERIES = [(1, "red fox"), (2, "the hen"), (3, "nothing known"), (4, None), (5, "FOX fox étude filler1 word7"), (6, "the")]


def same(spark, path, docs, k=3):
    q = spark.createDataFrame(QUERIES, "query_id int, query string")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(KI.search(spark, path, q, k)) == rows(H.bm25(docs.withColumn("text", F.coalesce("text", F.lit(""))), q, k))


def test_keyword_index_through_changes(spark, tmp_path):
    """Built, refreshed three times, compacted: the same as BM25 over the documents as they are. A text may change back."""
    path, texts = str(tmp_path / "i"), list(TEXTS)
    docs = docs_of(spark, texts)
    assert KI.refresh(docs, path, LAY).count() == len(texts)
    same(spark, path, docs)
    for step in ({0: "now the hen", 3: "the fox at last"}, {0: "the red fox", 7: None}, {}):
        for i, t in step.items():
            texts[i] = t
        docs = docs_of(spark, texts)
        assert {(r["id"], r["change"]) for r in KI.refresh(docs, path, LAY).collect()} == {(i, "changed") for i in step}
        same(spark, path, docs)
    fewer = docs.where("id not in (2, 6)").union(spark.createDataFrame([(99, "a new fox")], "id long, text string"))
    assert {(r["id"], r["change"]) for r in KI.refresh(fewer, path, LAY).collect()} == {(2, "removed"), (6, "removed"), (99, "added")}
    same(spark, path, fewer)
    KI.compact(spark, path, LAY)
    same(spark, path, fewer)
    assert KI.kept(spark, path).gens == (4,)
    KI.refresh(docs, path, LAY)
    same(spark, path, docs)


def test_only_changed_documents_are_written(spark, tmp_path):
    path = str(tmp_path / "i")
    KI.refresh(docs_of(spark, TEXTS), path, LAY)
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    KI.refresh(docs_of(spark, ["another"] + TEXTS[1:]), path, LAY)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert [r["id"] for r in spark.read.parquet(f"{path}/docs/gen=1").collect()] == [0]


def test_a_refresh_that_broke_is_as_if_it_had_not_been(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), docs_of(spark, TEXTS)
    KI.refresh(docs, path, LAY)
    new = docs_of(spark, ["fox fox fox"] + TEXTS[1:])
    for broken in ("_blocks", "log"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(KI, broken, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
            KI.refresh(new, path, LAY)
        same(spark, path, docs)
    KI.refresh(new, path, LAY)
    same(spark, path, new)


def test_plan_reads_asked_buckets_only(spark, tmp_path):
    path = str(tmp_path / "i")
    KI.refresh(docs_of(spark, TEXTS), path, LAY)
    q = spark.createDataFrame([(1, "fox")], "query_id int, query string")
    _, blocks, _ = KI.asked_blocks(spark, path, q)
    bucket = spark.range(1).select(KI._bucket(F.lit("fox"), 8).alias("b")).first()["b"]
    blocks.collect()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*\(bucket#\d+ = {bucket}\)", plan), plan
    numbers = re.findall(r"number of partitions read: *(\d+)", plan)
    assert all(n == "1" for n in numbers)


def test_blocks_below_the_bar_are_skipped(spark, tmp_path):
    """A term in all documents: its weak blocks can't reach the first k, and the result is the same without them."""
    path = str(tmp_path / "i")
    texts = [("word " * (60 - i)).strip() + " filler" * i for i in range(60)]
    docs = docs_of(spark, texts)
    KI.refresh(docs, path, KI.Layout(buckets=4, block=4, shard=1000))
    q = spark.createDataFrame([(1, "word")], "query_id int, query string")
    terms, blocks, have = KI.asked_blocks(spark, path, q)
    read = [r["read"] for r in KI.needed(terms, blocks, spark, path, have, 3).collect()]
    assert len(read) == 15 and 0 < sum(read) <= 3
    rows = lambda df: [(r["rank"], r["id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    assert rows(KI.search(spark, path, q, 3)) == rows(H.bm25(docs, q, 3))


def test_empty_keyword_index(spark, tmp_path):
    path, none = str(tmp_path / "i"), spark.createDataFrame([], "id string, text string")
    KI.refresh(none, path, LAY)
    q = spark.createDataFrame([(1, "fox")], "query_id int, query string")
    assert KI.search(spark, path, q).count() == 0 and KI.search(spark, path, q.limit(0)).count() == 0
    KI.refresh(spark.createDataFrame([("x", "the fox")], "id string, text string"), path)
    assert [r["id"] for r in KI.search(spark, path, q).collect()] == ["x"]


SIZES = VI.Sizes(per_cluster=50, least=100)


def points(n, seed, centres=None):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(1).normal(size=(40, 16)) if centres is None else centres
    return (c[rng.integers(0, len(c), n)] + rng.normal(scale=0.3, size=(n, 16))).astype(np.float32)


def frame(spark, x, first=0, collection=None):
    rows = [(first + i, v.tolist(), collection) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vector array<float>, collection string")


def nearest(x, q, k):
    d = np.sqrt(((x[None].astype(float) - q[:, None].astype(float)) ** 2).sum(-1))
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_recall_after_appends(spark, tmp_path):
    """Three appends, one of them into one corner, with upkeep after each: recall@10 of eight probes is at least 0.9."""
    path = str(tmp_path / "v")
    corner = np.random.default_rng(3).normal(size=(1, 16))
    parts = [points(1200, 10), points(400, 11), points(600, 12, corner), points(300, 13)]
    VI.create(frame(spark, parts[0]), path, SIZES)
    at, split = 1200, []
    for p in parts[1:]:
        VI.append(frame(spark, p, at), path, SIZES)
        split += VI.rebalance(spark, path, SIZES)["split"]
        at += len(p)
    x, q = np.concatenate(parts), points(60, 14)
    assert split and VI.vectors_of(spark, path).select("id").distinct().count() == VI.vectors_of(spark, path).count() == len(x)
    asked = frame(spark, q).select(F.col("id").alias("query_id"), "vector")
    found = {(r["query_id"], r["id"]) for r in VI.search(spark, path, asked, 10, 8).collect()}
    true = {(i, int(j)) for i, row in enumerate(nearest(x, q, 10)) for j in row}
    assert len(found & true) >= 0.9 * len(true)
    every = {(r["query_id"], r["id"]) for r in VI.search(spark, path, asked, 10, 10_000).collect()}
    assert every == true
    sizes = [r["count"] for r in VI.vectors_of(spark, path).groupBy("cluster_id").count().collect()]
    assert max(sizes) <= 4 * SIZES.per_cluster


def test_untouched_clusters_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "v")
    VI.create(frame(spark, points(1000, 20)), path, SIZES)
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = set(VI.catalog(spark, path).number.tolist())
    new = points(1, 21)
    VI.append(frame(spark, new, 5), path, SIZES)  # replaces vector 5
    after = VI.catalog(spark, path)
    gone = before - set(after.number.tolist())
    assert all(p.stat().st_mtime_ns == t for p, t in files.items()) and len(gone) == 1
    assert {p for p in VI.stale(spark, path)} == {f"{path}/vectors/gen=0/collection=default/cluster_id={c}" for c in gone}
    row = VI.vectors_of(spark, path).where("id = 5").collect()
    assert len(row) == 1 and np.allclose(row[0]["vector"], new[0])
    written = {int(p.parent.name.split("=")[1]) for p in Path(path).rglob("vectors/gen=1/**/*.parquet")}
    assert len(written) <= 2


def test_starved_clusters_merge_and_many_generations_are_packed(spark, tmp_path):
    path, x = str(tmp_path / "v"), points(600, 30)
    VI.create(frame(spark, x), path, SIZES)
    few = VI.Sizes(per_cluster=50, least=100, merge=0.9, spread=1)
    VI.append(frame(spark, points(40, 31), 600), path, SIZES)
    told = VI.rebalance(spark, path, few)
    assert told["merged"] and not set(told["merged"]) & set(VI.catalog(spark, path).number.tolist())
    rows = VI.vectors_of(spark, path)
    assert rows.count() == rows.select("id").distinct().count() == 640


def test_dimension_check_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    VI.create(frame(spark, points(120, 40)), path, SIZES)
    files = sorted(Path(path).rglob("*.parquet"))
    for bad in ([1.0] * 15, [float("nan")] * 16, None, [None] * 16):
        with pytest.raises(ValueError):
            VI.append(spark.createDataFrame([(900, [0.5] * 16), (901, bad)], "id long, vector array<float>"), path, SIZES)
    with pytest.raises(ValueError):
        VI.append(spark.createDataFrame([(None, [0.5] * 16)], "id long, vector array<float>"), path, SIZES)
    assert sorted(Path(path).rglob("*.parquet")) == files


def test_collections_are_pruned(spark, tmp_path):
    """Small collections have no centroids and are found all the same; a query of one collection reads its folders only."""
    path = str(tmp_path / "v")
    big, small_, late = points(300, 50), points(20, 51), points(130, 52)
    VI.create(frame(spark, big, 0, "big").union(frame(spark, small_, 1000, "small")), path, SIZES)
    VI.append(frame(spark, late[:60], 2000, "late").union(frame(spark, late[60:70], 3000, None)), path, SIZES)
    VI.append(frame(spark, late[70:], 2070, "late"), path, SIZES)
    c = VI.catalog(spark, path)
    assert (c.number[c.collection == "late"] < 0).all()
    assert VI.rebalance(spark, path, SIZES)["split"]
    c = VI.catalog(spark, path)
    assert (c.number[c.collection == "late"] >= 0).all()
    q = spark.createDataFrame([(1, small_[3].tolist(), "small"), (2, late[80].tolist(), "late"), (3, late[65].tolist(), None), (4, [1.0], "big"), (5, None, "big"), (6, big[0].tolist(), "none")], "query_id int, vector array<float>, collection string")
    first = {r["query_id"]: r["id"] for r in VI.search(spark, path, q, 1, 100).collect()}
    assert first == {1: 1003, 2: 2080, 3: 3005}
    read = VI.vectors_of(spark, path, c.where(c.collection == "small")).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("collection=small/" in r["f"] for r in read)
    plan = VI.vectors_of(spark, path, c.where(c.collection == "small"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cluster_id", plan)


def test_empty_vector_index(spark, tmp_path):
    path = str(tmp_path / "v")
    none = spark.createDataFrame([], "id long, vector array<float>")
    VI.create(none, path, SIZES)
    q = spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>")
    assert VI.search(spark, path, q).count() == 0
    VI.append(none, path, SIZES)
    VI.append(spark.createDataFrame([(7, [0.5])], "id long, vector array<float>"), path, SIZES)
    assert [r["id"] for r in VI.search(spark, path, q).collect()] == [7]


def test_postings_are_shuffled_once_and_in_turns(spark, tmp_path, monkeypatch):
    """Documents are counted without a shuffle and postings take one; buckets that take turns hold the same index."""
    docs = docs_of(spark, TEXTS).withColumn("text", F.coalesce("text", F.lit("")))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    counted = KI._counted(docs)
    assert exchanges(counted) == 0
    tally = {r["id"]: {t["term"]: t["tf"] for t in r["tfs"]} for r in counted.collect()}
    assert tally[1] == {"a": 1, "red": 2, "hen": 1} and tally[3] == tally[4] == {} and tally[7] == {"the": 5}
    monkeypatch.setattr(KI, "small", lambda df: True)
    assert exchanges(KI._blocks(counted, 5.0, LAY)) <= 2  # of these one for the sizes of terms
    monkeypatch.setattr(KI, "EACH", 1)
    path = str(tmp_path / "i")
    KI.refresh(docs_of(spark, TEXTS), path, LAY)
    assert len({p.name.split("-")[-1] for p in Path(path).rglob("postings/gen=0/**/*.parquet")}) and sum(r["count"] for r in spark.read.parquet(f"{path}/postings").groupBy("bucket").count().collect())
    same(spark, path, docs_of(spark, TEXTS))
