"""Formulas, guards and state rules on hand-made rows."""

from pyspark.sql import functions as F

from quarry.functions import lifecycle as L
from quarry.functions import text as T
from quarry.operators import queueing as Q
from quarry.operators import records as R
from quarry.operators import search as H
from quarry.operators import similarity as M
from quarry.sources import chunkers, transcripts


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (0,)], schema).select(column.alias("r")).first()["r"]


def test_titles(spark):
    assert one(spark, T.normal_title(F.col("t")), t=("string", "  Fix  THE\tBug… ")) == "fix the bug"
    assert one(spark, T.significant_tokens(F.col("t")), t=("string", "The API and the api of v2 db")) == ["api"]
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_versions(spark):
    v = lambda s: one(spark, T.version(F.col("t")), t=("string", s))
    assert tuple(v("release v1.10.2 done")) == (1, 10, 2)
    assert tuple(v("tool 3.4")) == (3, 4, 0)
    assert v("beta 1.2.3-rc1") is None and v("no version") is None and v(None) is None
    assert one(spark, T.version_entity(F.col("t")), t=("string", "Zeta release v1.2 alpha")) == "alpha release zeta"


def test_failure_classes(spark):
    for text, want in (("HTTP 429", "rate_limited"), ("HTTP 401 Unauthorized", "auth"), ("503 from host", "unreachable"), ("ECONNREFUSED", "unreachable"), ("odd", "other"), ("4290", "other")):
        assert one(spark, T.failure_class(F.col("t")), t=("string", text)) == want


def test_buoyancy_is_monotone(spark):
    df = spark.range(0, 400, 10).select(L.buoyancy(F.lit(7.0), F.lit(None).cast("long"), F.lit(40_000_000) - F.col("id") * 86400, F.lit(False), 40_000_000).alias("b"))
    b = [r["b"] for r in df.collect()]
    assert b[0] == 1.0 and b == sorted(b, reverse=True) and b[-1] > 0
    assert one(spark, L.buoyancy(F.lit(7.0), F.lit(0), F.lit(0), F.lit(True), 10**9)) == 1.0


def test_stability_depends_on_order(spark):
    fold = lambda *log: one(spark, L.folded_stability(F.col("e"), F.lit(7.0)), e=("array<struct<ts:long,seq:long,src:string>>", list(log)))
    a, b = fold((1, 1, "auto"), (2, 2, "drill")), fold((1, 1, "drill"), (2, 2, "auto"))
    assert a != b and 7 < min(a, b) < max(a, b) < 365
    assert fold() == 7.0


def test_merge_guard():
    assert not M.may_merge("cache works", "cache is broken")
    assert not M.may_merge("it isn’t ready", "it is ready")
    assert not M.may_merge("see #12", "see #13") and M.may_merge("see #12", "see #12 again")
    assert not M.may_merge("3.11 to 3.12", "3.12 to 3.13")
    assert M.may_merge("a/b/c.ts read", "wrote a/b/c.ts")
    assert M.may_merge("plain words", "plain word") and not M.may_merge("tenant A", "tenant B")


def test_merge_and_undo(spark):
    rows = [(1, "p", None, 1, 0, 0, 5, False), (2, "p", None, 2, 1, 0, 9, False), (3, "p", "b", 4, 0, 1, None, False)]
    r = spark.createDataFrame(rows, "id long, project_id string, branch string, from_auto long, from_search long, from_drill long, last_surfaced long, archived boolean")
    events = R.merge_events(r, spark.createDataFrame([(1, 2), (1, 3), (1, 1)], "survivor_id long, id long"))
    assert [tuple(e)[:2] for e in events.collect()] == [(1, 2)]  # another branch isn't merged
    done = R.merged(r, events)
    assert {tuple(x) for x in done.collect()} == {(1, "p", None, 3, 1, 0, 9, False), (2, "p", None, 2, 1, 0, 9, True), (3, "p", "b", 4, 0, 1, None, False)}
    assert sorted(map(tuple, R.unmerged(done, events, r.select("id", "last_surfaced")).collect()), key=lambda t: t[0]) == rows


def test_greedy_groups_meet_seeds_only(spark):
    rows = [(1, "alpha beta gamma", 9), (2, "beta gamma delta", 5), (3, "gamma delta epsilon", 1), (4, "alone", 0)]
    r = spark.createDataFrame([(i, "p", None, t, n, 0, 0) for i, t, n in rows], "id long, project_id string, branch string, title string, from_auto long, from_search long, from_drill long")
    assert {tuple(x) for x in M.title_groups(r, 0.5).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_dbscan(spark):
    p = spark.range(6)
    d = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.2), (1, 2, 0.3), (2, 3, 0.3), (4, 5, 0.1)], "a long, b long, distance double")
    assert {tuple(x) for x in M.dbscan(p, d).collect()} == {(0, 0, True), (1, 0, True), (2, 0, True), (3, 0, False), (4, None, False), (5, None, False)}


def test_fusion(spark):
    leg = "query_id long, id long, rank int, score double"
    v, k = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5)], leg), spark.createDataFrame([(1, 11, 1, 7.0), (1, 12, 2, 3.0)], leg)
    got = {r["id"]: round(r["score"], 6) for r in H.weighted(v, k).collect()}
    assert got == {10: 0.9, 11: round(0.7 * 0.5 + 0.3, 6), 12: 0.0}
    only = {r["id"]: r["score"] for r in H.weighted(v.limit(0), k.limit(1)).collect()}
    assert list(only.values()) == [1.0]
    fused = {r["id"]: r["score"] for r in H.rrf([v, k]).collect()}
    assert fused[11] <= 1 and fused[10] == 0.5 and H.rrf([v.limit(0), k.limit(0)]).count() == 0


def test_queue_null_keys(spark):
    rows = [(1, "s", 1, "done"), (2, "s", 1, "pending"), (3, "s", None, "pending"), (4, "s", None, "pending"), (5, "s", 2, "pending"), (6, "s", 2, "pending"), (7, "s", None, "done")]
    q = spark.createDataFrame(rows, "id long, session_id string, prompt_number int, status string")
    assert {r["id"] for r in Q.to_delete(q).collect()} == {2, 4, 6}


def test_backoff(spark):
    wait = lambda n, after=0: one(spark, Q.backoff_ms(F.lit(n), F.lit(0.0), F.lit(after)))
    assert wait(1) == 7500 and wait(2) == 15000 and wait(20) == 300_000 and wait(1, 90_000) == 90_000


def test_sections_know_fences(spark):
    text = "---\nname: x\ndescription: d: e\n---\nintro\n\n## One\n```\n## not a head\n```\n## Two\nend"
    d = spark.createDataFrame([(1, text)], "id long, text string")
    got = [(r["section_kind"], r["title"], r["has_code"], r["description"]) for r in chunkers.memory_chunks(d).orderBy("position").collect()]
    assert got == [("intro", None, False, "d: e"), ("h2", "One", True, "d: e"), ("h2", "Two", False, "d: e")]
    assert chunkers.skill_chunks(d).orderBy("position").first()["text"] == "d: e\n\nintro"


def test_split_keeps_all_words():
    text = "## A\n" + "one two three. " * 40 + "\n\n## B\n" + "four five\n" * 30
    parts = chunkers.split_text(text, 20)
    assert " ".join(parts).split() == text.split() and all(len(p.split()) <= 20 for p in parts)
    assert chunkers.split_text("", 5) == [] and len(chunkers.split_text("x" * 500, 5)) == 7


def test_turns_and_times(spark):
    rows = [(1, 0, "assistant", 5), (1, 1, "user", None), (1, 2, "system", 7), (1, 3, "assistant", None), (1, 4, "user", 9)]
    e = spark.createDataFrame(rows, "conv_id long, turn long, role string, ts long")
    assert [(r["turn"], r["turn_no"]) for r in transcripts.turns(e).orderBy("turn").collect()] == [(0, 1), (1, 1), (3, 1), (4, 2)]
    assert [r["ts"] for r in transcripts.carried(e, "conv_id", "turn").orderBy("turn").collect()] == [5, 5, 7, 7, 9]


def test_streams(spark, tmp_path):
    from quarry.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id":1,"session_id":"s","project_id":"p","prompt_number":1,"tool_name":"t","ts":1,"files":["x"]}\n{"id":2,"session_id":"s","project_id":"p","prompt_number":1,"tool_name":"u","ts":2,"files":["y","x"]}\n')
    ingest.observations_to(ingest.event_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["tool_name"], r["events"], r["files"]) for r in got] == [("t", 2, ["x", "y"])]


def test_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<double>")
    q = v.limit(5).withColumnRenamed("id", "query_id")
    want = {tuple(r)[:3] for r in H.knn(v, q, 2).collect()}
    monkeypatch.setattr(H.in_blocks, "__defaults__", (2,))
    assert {tuple(r)[:3] for r in H.knn(v, q, 2).collect()} == want


def test_dbscan_of_a_long_chain(spark):
    """A chain of cores is one cluster, also where its ids grow away from the least one."""
    n = 300
    # 1 - a_n ... a_1 - 2, and ids of the a grow away from 2
    path = [1, *range(2 + n, 2, -1), 2]
    near = [(min(a, b), max(a, b), 0.1) for a, b in zip(path, path[1:])]
    got = M.dbscan(spark.range(1, n + 3), spark.createDataFrame(near, "a long, b long, distance double"), least=2).collect()
    assert len(got) == n + 2 and {(r["cluster"], r["is_core"]) for r in got} == {(1, True)}
    loop = M.components(spark.createDataFrame([(5, 5), (7, 6)], "a long, b long")).collect()
    assert sorted(map(tuple, loop)) == [(5, 5), (6, 6), (7, 6)]


def test_view_without_a_page(spark, monkeypatch):
    """title_search gives all that match, also beyond 10,000."""
    from quarry.plans import more
    from quarry.plans import tables as X

    none = F.lit(0).cast("long")
    o = spark.range(10_050).select("id", F.lit("about V1.2 here").alias("title"), F.lit(False).alias("archived"), none.alias("from_auto"), none.alias("from_search"), none.alias("from_drill"), none.alias("last_surfaced"), F.lit("s").alias("session_id"))
    monkeypatch.setattr(X, "observations", lambda spark, d: o)
    assert more.title_search(spark, "").count() == 10_050 and R.page(o, limit=10).count() == 10
