"""Search and index on hand-made rows."""

from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import passes as P
from quarry.operators import queueing as Q
from quarry.operators import search as H
from quarry.operators import stats as S
from quarry.sources import chunkers


def corpus(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "a", "m", "s"), (2, "alpha beta", "b", "m", "t"), (3, "alpha gamma", "b", "o", "s")], "id long, text string, branch string, channel string, skill string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, "alpha", [1.0, 0.0], "b")], "query_id long, query string, vector array<double>, current_branch string")
    return docs, vectors, asked


def test_branch_and_tide_move_hits(spark):
    docs, vectors, asked = corpus(spark)
    order = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert order(H.hybrid(docs.drop("branch"), vectors, asked)) == [1, 2, 3]
    assert order(H.hybrid(docs, vectors, asked)) == [2, 3, 1]
    tide = spark.createDataFrame([(2, 0.5)], "id long, multiplier double")
    assert order(H.hybrid(docs, vectors, asked, tide=tide)) == [3, 1, 2]
    # weighed before the cut: what sinks makes room
    assert order(H.hybrid(docs, vectors, asked, k=1, tide=tide)) == [3]


def test_filters_of_a_channel(spark):
    docs, vectors, asked = corpus(spark)
    for early in (False, True):
        got = P.search_channel(docs, vectors, asked, "m", prefilter=early, where=F.col("skill") == "s").collect()
        assert [(r["id"], r["rank"]) for r in got] == [(1, 1)]


def test_many_terms_join_by_a_shuffle(spark, monkeypatch):
    docs, _, asked = corpus(spark)
    few = sorted(map(tuple, H.bm25(docs, asked).collect()))
    monkeypatch.setattr(H, "small", lambda df: False)
    assert sorted(map(tuple, H.bm25(docs, asked).collect())) == few and len(few) == 3


def test_written_index(spark, tmp_path):
    v = spark.range(400).select("id", F.array(F.cos(F.col("id") / 10), F.sin(F.col("id") / 10)).alias("vector"))
    none, centroids = I.built(v)
    assert centroids is None and none.select("cluster_id").distinct().collect()[0][0] == -1
    index, centroids = I.built(v, least=100, per_cluster=50)
    I.write(index, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r["id"] for r in back.select("id").collect()) == list(range(400))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    near = lambda ix, n: [r["id"] for r in I.probed(ix, centroids, asked, k=5, probes=n).orderBy("rank").collect()]
    exact = [r["id"] for r in H.knn(v, asked, 5).orderBy("rank").collect()]
    assert near(back, 8) == exact and near(back, 3) == near(index, 3)
    s = I.summary(index, centroids).first()
    assert (s["clusters"], s["vectors"], s["assigned"]) == (8, 400, 400)


def test_events_that_may_be_queued(spark):
    rows = [("s", "p", 0, "t", 5, "x" * 3000, None), ("", "p", 0, "t", 5, "", []), ("s", None, 0, "t", 5, "", []), ("s", "p", -1, "t", 5, "", []), ("s", "p", None, "t", 5, "", []), ("s", "p", 1, "t", None, "", [])]
    e = spark.createDataFrame(rows, "session_id string, project_id string, prompt_number int, tool_name string, ts long, tool_input_summary string, files array<string>")
    (one,) = Q.accepted(e).collect()
    assert len(one["tool_input_summary"]) == 2000 and one["files"] == []


def test_totals_of_nothing(spark):
    u = spark.createDataFrame([], "session_id string, parent_id string, ts long, fresh long, output long, cached long")
    t = S.usage_totals(u, 0).first()
    assert (t["sessions"], t["agents"], t["oldest"], t["fresh"], t["window_cached"]) == (0, 0, None, 0, 0)
    p = spark.createDataFrame([("summary",), ("x",), (None,)], "kind string")
    assert {tuple(r) for r in S.migration_counts(p).collect()} == {("observation", 0), ("summary", 1)}


def test_model_limits(spark):
    df = spark.createDataFrame([("maker/voyage-4-nano",), ("voyage-code-2",), ("other",), (None,)], "m string")
    assert [r[0] for r in df.select(chunkers.model_limit(F.col("m"))).collect()] == [512, 16_000, 512, 512]


def test_nearest_with_odd_vectors(spark):
    """Nulls, other lengths and non-finite parts are near nothing; of equal vectors the lower ids come first."""
    rows = [(9, [1.0, 0.0]), (3, [1.0, 0.0]), (1, None), (2, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [2.0])], "query_id int, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in H.knn(v, asked, 2).collect()}
    assert got == {(1, 1): 3, (1, 2): 9, (3, 1): 2}
    assert H.knn(v, asked.limit(0), 2).count() == 0 == H.knn(v.limit(0), asked, 2).count()
