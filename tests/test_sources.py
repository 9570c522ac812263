"""Readers on small files, imports, and streams against batch."""

import json

from pyspark.sql import functions as F

from quarry.operators import passes, stats
from quarry.sources import chunkers, files, transcripts
from quarry.streaming import ingest


def test_markdown(spark, tmp_path):
    d = tmp_path / ".claude"
    d.mkdir()
    (d / "a.md").write_bytes(b"# T\r\n\r\n## One\r\nx")
    (d / "b.txt").write_text("no")
    rows = chunkers.markdown(spark, str(d)).collect()
    assert [(r["tool"], r["text"]) for r in rows] == [("claude", "# T\n\n## One\nx")]


def test_usage(spark, tmp_path):
    line = lambda i, n, t: json.dumps({"timestamp": t, "message": {"id": i, "usage": {"input_tokens": n, "output_tokens": 1}}})
    (tmp_path / "s1.jsonl").write_text("\n".join([line("m", 5, "2024-01-01T00:00:30Z"), line("m", 9, "2024-01-01T00:00:40Z"), "{broken", line("n", 1, "2024-01-01T00:02:00Z"), '{"type":"other"}']))
    u = transcripts.usage_lines(spark, str(tmp_path))
    r = stats.usage_by_session(u, transcripts.USAGE_FIELDS).first()
    assert (r["session_id"], r["messages"], r["input_tokens"], r["output_tokens"]) == ("s1", 2, 10, 2)
    assert u.agg(F.min("ts")).first()[0] == 1704067230


def test_transcripts_of_other_tools(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"timestamp":"1","payload":{"type":"user_message","message":"hi"}}\n{"timestamp":"2","payload":{"type":"function_call","name":"sh","arguments":"ls"}}\n{"timestamp":"3","payload":{"type":"token_count"}}\n')
    got = [(r["session_id"], r["role"], r["text"], r["tool"]) for r in files.rollout_entries(spark, str(tmp_path / "r.jsonl")).orderBy("place").collect()]
    assert got == [("r", "user", "hi", None), ("r", "assistant", "ls", "sh")]
    (tmp_path / "g.json").write_text('{"sessionId":"g","messages":[{"type":"user","content":"a"},{"role":"assistant","content":"b"}]}')
    assert [tuple(r)[1:] for r in transcripts.json_messages(spark, str(tmp_path / "g.json")).orderBy("place").collect()] == [(0, "user", "a"), (1, "assistant", "b")]
    (tmp_path / "k.jsonl").write_text('{"role":"user","content":"q"}\n{"role":"tool","content":"z"}\n')
    assert [tuple(r) for r in files.role_lines(spark, str(tmp_path / "k.jsonl")).collect()] == [("k", "user", "q")]


def test_blobs(spark):
    blob = bytearray(b"\x00abcd\x01\xffxy\x00first line\nfirst line\nsecond\x80" + b"z" * 20000)
    b = spark.createDataFrame([(1, blob), (2, bytearray()), (3, None)], "id int, content binary")
    got = files.printable_pieces(b).orderBy("piece").collect()
    assert len(got) == 8 and all(len(r["text"]) == 2000 for r in got)
    assert got[0]["text"].startswith("abcd\nfirst line\nsecond\nzzz")


def test_parts_join(spark):
    s = spark.createDataFrame([("s",)], "session_id string")
    m = spark.createDataFrame([("s", "m", "user"), ("t", "n", "user")], "session_id string, message_id string, role string")
    p = spark.createDataFrame([("m", 2, 1, "b"), ("m", 1, 2, "a"), ("n", 1, 3, "c")], "message_id string, time int, part_id int, text string")
    assert [r["text"] for r in transcripts.joined_parts(s, m, p).collect()] == ["a\nb"]


def test_import(spark):
    cols = "id long, memory_session_id string, type string, title string, narrative string, facts string, concepts string, files_read string, files_modified string, created_at_epoch long"
    rows = [(1, "s", "change", None, None, '["f"]', None, "bad", "[]", 1700000000999), (2, "s", "change", "t", "n", None, None, None, None, 5)]
    got = files.legacy_records(spark.createDataFrame(rows, cols), spark.createDataFrame([(2,)], "id long"), "p").collect()
    assert [(r["id"], r["title"], r["facts"], r["files_read"], r["created"]) for r in got] == [(1, "", ["f"], [], 1700000000)]


def test_settled_and_deleted(spark):
    f = spark.createDataFrame([("a", 10, "x"), ("b", 95, "x"), ("c", 10, "y")], "path string, mtime long, marker string")
    assert [r["path"] for r in files.settled(f, 100, spark.createDataFrame([("c", "y")], "path string, marker string")).collect()] == ["a"]
    chunks = spark.createDataFrame([(1, "p"), (2, "q")], "document_id long, text string")
    assert files.without_documents(chunks, chunks.where("document_id = 1")).count() == 1


def test_log_and_manifest(spark, tmp_path):
    files.append_log(spark.range(3), str(tmp_path / "log"), "2024-01-01")
    files.append_log(spark.range(2), str(tmp_path / "log"), "2024-01-02")
    assert spark.read.parquet(str(tmp_path / "log")).where("day = '2024-01-02'").count() == 2
    (tmp_path / "x.bin").write_bytes(b"abc")
    m = files.manifest(spark.read.format("binaryFile").load(str(tmp_path / "x.bin"))).first()
    assert m["bytes"] == 3 and len(m["sha"]) == 64


def test_promotions(spark):
    r = spark.createDataFrame([(i, "decision", i, 0, 0, False, None, i) for i in range(9)], "id long, type string, from_auto long, from_search long, from_drill long, archived boolean, promoted_at long, created long")
    got = passes.promotions(r, lambda c: c.where("id % 2 = 0"), 77)
    assert {(x["id"], x["promoted_at"]) for x in got.collect()} == {(8, 77), (6, 77), (4, 77)}


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_capture_goes_on_where_it_was(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, entries in enumerate((["a", "b"], ["a", "b", "c"], ["a"])):
        (src / f"{i}.json").write_text(json.dumps({"session_id": "s", "entries": entries}) + "\n")
    stream = spark.readStream.schema("session_id string, entries array<string>").option("maxFilesPerTrigger", 1).json(str(src))
    run(ingest.captured(stream), tmp_path, "captured")
    assert sorted((r["n"], r["text"]) for r in spark.table("captured").collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_minutes_as_in_batch(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    rows = [("s", 1704067200 + 17 * i, i) for i in range(40)] + [("s", 1704067200 + 86400, 0)]
    (src / "0.json").write_text("\n".join(json.dumps({"session_id": s, "ts": t, "tokens": n}) for s, t, n in rows))
    stream = spark.readStream.schema("session_id string, ts long, tokens long").json(str(src)).withColumn("at", F.timestamp_seconds("ts"))
    run(ingest.minute_usage(stream), tmp_path, "minutes")
    batch = stats.minute_buckets(spark.createDataFrame(rows[:-1], "session_id string, ts long, tokens long"), 0)
    assert {tuple(r) for r in spark.table("minutes").collect()} == {tuple(r) for r in batch.collect()}
