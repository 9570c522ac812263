"""Text tools and reports on hand-made values."""

import math

from quarry.operators import context as C
from quarry.operators import queueing as Q
from quarry.operators import semantic as G
from quarry.operators import stats as S


def test_json_repair():
    assert C.repaired_json('so: {"a": "say "hi" now", "b": [1, 2]} ok') == '{"a": "say \\"hi\\" now", "b": [1, 2]}'
    assert C.repaired_json('{"a": "x\\"y"}') == '{"a": "x\\"y"}'
    assert C.repaired_json("none") is None and C.repaired_json(None) is None and C.repaired_json("{a}") is None


def test_git_ops():
    assert C.git_op("cd x && GIT_DIR=a git -C /y commit -m z") == "commit"
    assert C.git_op("git status; git --no-pager log | cat") is None
    assert C.git_op("echo git commit") is None and C.git_op(None) is None
    assert C.git_op("ls || git -c a=b cherry-pick x") == "cherry-pick"


def test_gap_and_tau_agree():
    gap = C.bridgeable_days(0.35, 7.0)
    assert 18 < gap < 20
    assert math.isclose(C.bridgeable_days(0.35, C.tau_for(30, 0.35)), 30)
    assert C.bridgeable_days(0.5, 7.0) == math.inf and C.tau_for(30, 0.5) == 0.0
    assert C.bridgeable_days(0.0, 7.0) == 0.0


def test_permutations():
    assert C.permutation_p([1, 2, 3] * 20, [1, 2, 3] * 20) > 0.5
    assert C.permutation_p([1.0] * 30, [5.0] * 30) < 0.01
    assert C.permutation_p([], [1.0]) == 1.0


def test_blocking():
    assert C.blocking(True, 1, 2) == ["summarizing", "queue", "co-session"] and C.blocking(False, 0, 0) == []


def test_envelope_order_and_budget(spark):
    rows = [(1, 1, "observation", "o", "x y z", 0.5), (1, 2, "memory", "m", "a b", 0.4), (1, 3, "other", "q", "c", 0.1)]
    h = spark.createDataFrame(rows, "query_id int, rank int, channel string, title string, snippet string, score double")
    text = C.envelopes(h).first()["envelope"]
    assert text.index("## memory") < text.index("## observation") < text.index("## other")
    short = C.envelopes(h, 6).first()["envelope"]
    assert C.MARKER in short and len(short) < len(text)


def test_front_matter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("\n  Hello, World!\nmore   text", "note"), ("", "note"), ("!!!", "note")], "b string, k string")
    got = [tuple(r["f"]) for r in df.select(C.front_matter_of(F.col("b"), F.col("k")).alias("f")).collect()]
    assert got == [("Hello, World!", "Hello, World! more text", "hello-world"), ("note", "", "note"), ("!!!", "!!!", "note")]


def test_theme_needs_two_sessions_and_use(spark):
    cols = "id long, title string, session_id string, project_id string, branch string, from_auto long, from_search long, from_drill long, is_anchored boolean, last_surfaced long"
    rows = [(1, "a b c", "s1", "p", None, 3, 0, 0, False, 1), (2, "a b d", "s2", "p", None, 1, 0, 0, False, 5), (3, "a b e", "s1", "p", None, 1, 0, 0, False, 2), (4, "a b", "s3", "q", None, 1, 0, 0, False, 2), (5, "a", "s4", "p", None, 0, 0, 9, False, 1)]
    r = spark.createDataFrame(rows, cols)
    v = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(1, 6)], "id long, vector array<double>")
    t = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.01), (1, 4, 0.9), (1, 5, 0.9)], "a long, b long, similarity double")
    stars = G.theme_clusters(r, v, t)
    assert {tuple(x) for x in stars.collect()} == {(1, 1), (1, 2)}
    none = spark.createDataFrame([], "cluster_key string, declined_at long")
    made = G.themes(r, stars, none, 1000).first()
    assert (made["member_ids"], made["from_auto"], made["last_surfaced"], made["cluster_key"]) == ([1, 2], 4, 5, "1,2")
    assert G.themes(r, stars, spark.createDataFrame([("1,2", 900)], none.schema), 1000).count() == 0


def test_repeated_messages_count_once(spark):
    u = spark.createDataFrame([("s", "m", 5), ("s", "m", 9), ("s", "n", 1), ("t", "m", 2)], "session_id string, message_id string, tokens long")
    assert {tuple(r) for r in S.usage_by_session(u, ("tokens",)).collect()} == {("s", 2, 10), ("t", 1, 2)}


def test_globs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("./a/b.py",), ("a/",), ("a/*/c",), ("*",), (None,)], "g string")
    assert [tuple(r["x"]) for r in df.select(Q.glob_base(F.col("g")).alias("x")).collect()] == [(False, "a/b.py"), (True, "a"), (True, "a"), (True, ""), (True, "")]
