"""Key-value log, watched folders, memory files, audit records, the dream report and texts of numbers."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import kv, passes, similarity
from quarry.sources import memory_files
from quarry.streaming import watch


def test_kv_log(spark):
    rows = [(1, "a%b", "1"), (2, "a%b", "2"), (3, "axb", "3"), (4, "a_c", "4"), (5, "a_c", None), (6, "abc", "5"), (7, None, "x"), (8, "gone", None), (9, "a%d", ""), (10, "a_c", "6"), (11, "a_c", None)]
    log = spark.createDataFrame(rows, "seq long, key string, value string")
    told = lambda df: {(r["key"], r["value"]) for r in df.collect()}
    assert told(kv.current(log)) == {("a%b", "2"), ("axb", "3"), ("abc", "5"), ("a%d", "")}
    assert told(kv.listed(log, "a%")) == {("a%b", "2"), ("a%d", "")} and told(kv.listed(log, "a_")) == set() and told(kv.listed(log, "")) == told(kv.current(log))
    assert told(kv.current(kv.compacted(log))) == told(kv.current(log)) and kv.compacted(log).count() == 4
    assert kv.current(log.limit(0)).count() == 0


def test_watched_folder_across_restarts(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "sub").mkdir(parents=True)

    def run():
        done = set(out.glob("*.parquet")) if out.exists() else set()
        watch.register(spark)
        stream = spark.readStream.format(watch.NAME).option("pattern", r"\.md$").load(str(src))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        new = [str(p) for p in out.glob("*.parquet") if p not in done]
        return {(r["path"].removeprefix(str(src) + "/"), r["change"]) for r in spark.read.schema(watch.SCHEMA).parquet(*new).collect()} if new else set()

    (src / "a.md").write_text("1")
    (src / "sub" / "b.md").write_text("1")
    (src / "c.txt").write_text("1")
    assert run() == {("a.md", "added"), ("sub/b.md", "added")}
    assert run() == set()
    (src / "a.md").write_text("22")
    (src / "sub" / "b.md").unlink()
    (src / "d.md").write_text("")
    assert run() == {("a.md", "changed"), ("sub/b.md", "removed"), ("d.md", "added")}
    (src / "sub" / "b.md").write_text("1")
    assert run() == {("sub/b.md", "added")}


def test_memory_files(spark, tmp_path):
    """Created, updated by name and by target, two of one name, quotes and line ends, a run again, and rows that can't be written."""
    old = tmp_path / "old.md"
    old.write_bytes(b'---\r\nname: "x"\r\n---\r\n\r\nfirst thought\r\n')
    rows = [(1, "feedback_a.md", None, 'say "hi"', "d\ne", "feedback", " one \n"), (2, "feedback_a.md", None, "n2", "d2", "feedback", "two"), (3, "b.md", str(old), "n3", None, "fact", "second thought"), (4, "c.md", None, "n", "d", "fact", "  "), (5, "c.md", None, "n", "d", None, "body"), (6, "sub/d.md", None, None, "d", "fact", "first")]
    df = spark.createDataFrame(rows, "id long, file string, target string, name string, description string, type string, body string")
    told = lambda: {(r["id"], r["path"].rpartition("/")[2], r["action"]) for r in memory_files.write(df, str(tmp_path / "m")).collect()}
    assert told() == {(1, "feedback_a.md", "created"), (2, "feedback_a.md", "updated"), (3, "old.md", "updated"), (6, "d.md", "created")}
    text = (tmp_path / "m" / "feedback_a.md").read_text()
    assert text == '---\nname: "n2"\ndescription: "d2"\ntype: feedback\n---\n\none\n\ntwo\n' and memory_files.body_of(old.read_text()) == "first thought\n\nsecond thought"
    assert {a for *_, a in told()} == {"updated"} and (tmp_path / "m" / "feedback_a.md").read_text() == '---\nname: "n2"\ndescription: "d2"\ntype: feedback\n---\n\none\n\ntwo\n'
    assert sorted(p.name for p in (tmp_path / "m").rglob("*") if p.is_file()) == ["d.md", "feedback_a.md"] and memory_files.write(df.limit(0), str(tmp_path / "m")).count() == 0


def test_audit_hits_become_records(spark):
    lines = spark.createDataFrame([(1, ["c1", "c2", "c1", "zz"]), (2, ["c3", "c4", "c5"]), (3, []), (4, None)], "line_id long, doc_ids array<string>")
    chunks = spark.createDataFrame([("c1", '{"observation_id": 7}'), ("c2", '{"observation_id": "9"}'), ("c2", '{"observation_id": "9"}'), ("c3", "{}"), ("c4", '{"observation_id": -1}'), ("c5", '{"observation_id": 1.5}'), (None, '{"observation_id": 3}')], "chunk_id string, metadata string")
    assert {r["line_id"]: r["ids"] for r in similarity.audit_records(lines, chunks).collect()} == {1: [7, 9, 7], 2: [], 3: [], 4: []}


def test_dream_report(spark):
    ids = [1, 2, 3, 11, 12, 13, 30]
    near = [(1, 2), (1, 3), (2, 3), (11, 12), (11, 13), (12, 13)]
    points = spark.createDataFrame([(i, i * 86400) for i in ids], "id long, created long")
    distances = spark.createDataFrame([(a, b, 0.1) for a, b in near], "a long, b long, distance double")
    together = spark.createDataFrame([(1, 2, 4), (2, 3, 1), (3, 11, 9), (12, 30, 2)], "a long, b long, together long")
    got = {r["cluster"]: r.asDict() for r in passes.dream_report(points.select("id"), distances, points, together).collect()}
    few = {c: (r["members"], r["co_weight"], r["first"], r["last"], r["span_days"], r["total"], r["without_co"]) for c, r in got.items()}
    clusters = sorted(c for c in few if c is not None)
    assert few[clusters[0]] == (3, 5, 86400, 3 * 86400, 2.0, 7, 1) and few[clusters[1]] == (3, 0, 11 * 86400, 13 * 86400, 2.0, 7, 1) and few[None] == (1, 0, 30 * 86400, 30 * 86400, 0.0, 7, 1)


@pytest.mark.parametrize(("n", "size", "time"), [(0, "0 B", "0s"), (59, "59 B", "59s"), (1023, "1023 B", "17m 3s"), (1536, "1.5 KB", "25m 36s"), (9000, "8.8 KB", "2h 30m"), (2 * 1024**2, "2.0 MB", "582h 32m"), (3489660928, "3.25 GB", "969350h 15m"), (None, None, None)])
def test_texts_of_numbers(spark, n, size, time):
    df = spark.createDataFrame([(n,)], "n long")
    r = df.select(T.bytes_text(F.col("n")).alias("b"), T.elapsed_text(F.col("n")).alias("e"), T.day_text(F.col("n")).alias("d")).first()
    assert (r["b"], r["e"]) == (size, time) and (n != 0 or r["d"] == "1970-01-01")
