"""Streams across restarts: byte offsets of files that grow, shrink and are replaced; leases that expire."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import queueing
from quarry.streaming import leases, tail


@pytest.fixture
def follow(spark, tmp_path):
    """Runs the stream until it has read all, from its checkpoint on, and returns what was new as {path: [(at, line)]}."""
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()

    def run(**options):
        done = {p.name for p in out.glob("*.parquet")} if out.exists() else set()
        tail.register(spark)
        stream = spark.readStream.format(tail.NAME).options(**{"pattern": r"\.jsonl$"} | options).load(str(src))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        new = [str(p) for p in out.glob("*.parquet") if p.name not in done]
        rows = spark.read.schema(tail.SCHEMA).parquet(*new).collect() if new else []
        got: dict = {}
        for r in sorted(rows, key=lambda r: (r["path"], r["at"])):
            got.setdefault(r["path"].rpartition("/")[2], []).append((r["at"], r["line"]))
        return got

    return src, run


def test_appends_truncation_and_replacement_across_restarts(follow):
    src, run = follow
    a, b = src / "a.jsonl", src / "sub" / "b.jsonl"
    b.parent.mkdir()
    (src / "other.txt").write_text("not asked for\n")
    a.write_bytes("eins\nzwei é\r\nunfinished".encode())
    assert run() == {"a.jsonl": [(0, "eins"), (5, "zwei é")]}
    assert run() == {}
    with a.open("ab") as f:
        f.write(b" now\n\nmore\n")
    b.write_bytes(b"first\nsecond\n\xff bad\n")
    assert run() == {"a.jsonl": [(14, "unfinished now"), (29, ""), (30, "more")], "b.jsonl": [(0, "first"), (6, "second"), (13, "\ufffd bad")]}
    a.write_bytes(b"eins\nshort\n")  # cut short: the same first line
    assert run() == {"a.jsonl": [(0, "eins"), (5, "short")]}
    b.write_bytes(b"replaced by a longer file\n" * 3)
    assert run() == {"b.jsonl": [(26 * i, "replaced by a longer file") for i in range(3)]}
    with b.open("ab") as f:
        f.write(b"and appended\n")
    a.unlink()
    assert run() == {"b.jsonl": [(78, "and appended")]}
    a.write_bytes(b"eins\n")
    assert run() == {"a.jsonl": [(0, "eins")]}


def test_ranges_of_any_size_read_every_line_once(follow):
    src, run = follow
    rng = random.Random(2)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + "é" for _ in range(300)]
    (src / "big.jsonl").write_text("\n".join(lines) + "\n")
    (src / "empty.jsonl").write_text("")
    got = run(rangeBytes="97")["big.jsonl"]
    assert [line for _, line in got] == lines


def test_partitions_of_offsets():
    r = tail.LineTailReader({"path": "/x", "rangeBytes": "10"})
    o = lambda n, h="h": {"bytes": n, "head": h}
    assert r.partitions({"f": o(5)}, {"f": o(5)}) == [] == r.partitions({"f": o(5)}, {})
    assert r.partitions({"f": o(5)}, {"f": o(27)}) == [tail.Range("f", 5, 15, True), tail.Range("f", 15, 25, False), tail.Range("f", 25, 27, False)]
    assert [(x.start, x.end) for x in r.partitions({"f": o(5)}, {"f": o(4)})] == [(0, 4)] == [(x.start, x.end) for x in r.partitions({"f": o(3)}, {"f": o(4, "new")})]


NOTE = "id long, session_id string, ts long, ttl_s long, repo_root string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_leases_equal_the_batch_after_restarts(spark, tmp_path, rocks):
    """Renewed, replaced, short, long and null leases, ties, several notes in a batch; each file is a batch, and the stream is begun anew for each two."""
    rng, now, notes = random.Random(4), 1_700_000_000_000, []
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    for step in range(6):
        now += 400_000
        rows = [{"id": step * 100 + i, "session_id": rng.choice(["s1", "s2", "s3", "s4", None]), "ts": now + rng.randrange(0, 4) * 1000, "ttl_s": rng.choice([None, 1, 300, 900, 10**6]), "repo_root": rng.choice([None, "r"])} for i in range(4)]
        rows[0]["ts"] = now + 3000
        notes += rows
        (src / f"{step}.json").write_text("\n".join(map(json.dumps, rows)))
        if step % 2:
            stream = spark.readStream.schema(NOTE).option("maxFilesPerTrigger", 1).json(str(src))
            q = leases.changes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
            q.awaitTermination()
            told = spark.read.parquet(str(out))
            last = told.groupBy("session_id").agg(F.max_by(F.struct("id", "until", "state"), F.struct("ts", "id", F.col("state") == "held", (F.col("state") == "expired").alias("over"))).alias("x"))
            held = {r["session_id"]: r["x"]["id"] for r in last.collect() if told.where((F.col("id") == r["x"]["id"]) & (F.col("state") == "expired")).isEmpty()}
            batch = spark.createDataFrame([tuple(n.values()) for n in notes], NOTE).where("session_id is not null")
            want = {r["session_id"]: r["id"] for r in queueing.live(queueing.latest_claims(batch), now + 3000).collect()}
            assert held == want
    assert told.groupBy("id", "state").count().where("count > 1").isEmpty()
    assert not told.where("state = 'expired'").isEmpty()
