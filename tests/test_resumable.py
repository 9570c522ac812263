"""Work that goes on where it broke: imports by key ranges, judges behind kept answers, themes as a log, compressed rollouts."""

import json
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.operators import judging, theme_log
from quarry.sources import migration, rollouts


def source(spark, n, first=1):
    return spark.createDataFrame([(i * 3, f"row {i}" if i % 5 else "", i % 7 == 0) for i in range(first, n + 1)], "id long, text string, bad boolean")


def taken(rows):
    """Two pieces a row; rows of empty text give none, and bad ones an error."""
    pieces = rows.where("text <> ''").withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1))))
    return pieces.select("id", "piece", "text", F.when(F.col("bad"), "can't be read").alias("error"))


def want(n):
    ids = [i for i in range(1, n + 1) if i % 5 and i % 7]
    return sorted((i * 3, p, f"row {i}") for i in ids for p in (0, 1))


def rows_of(df):
    return sorted((r["id"], r["piece"], r["text"]) for r in df.select("id", "piece", "text").collect())


def test_import_that_breaks_after_each_step(spark, tmp_path, monkeypatch):
    """Broken while planning, while writing a range, after writing it and while committing: the next run goes on, and in the end all is there once."""
    path, rows = str(tmp_path / "m"), source(spark, 60)

    def broken(*a, **b):
        raise RuntimeError("lost")

    written, commit = migration._write, migration._commit

    def half(pieces, at):
        written(pieces.limit(3), at)
        raise RuntimeError("lost")

    for name, f in (("_planned", broken), ("_write", broken), ("_write", half), ("_commit", broken), ("log", broken)):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(migration, name, f)
            migration.migrate(rows, path, "observation", taken, batch=17)
        assert migration.migrated(spark, path, "observation") is None
        assert migration.progress(spark, path).agg(F.sum("done")).first()[0] in (None, 0)
    calls = []
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(migration, "_commit", lambda *a: calls.append(a) or (broken() if len(calls) == 3 else commit(*a)))
        migration.migrate(rows, path, "observation", taken, batch=17)
    assert migration.progress(spark, path).first()["done"] == 2
    told = migration.migrate(rows, path, "observation", taken, batch=17).first().asDict()
    assert told == {"kind": "observation", "ranges": 4, "done": 4, "seen": 60, "migrated": 41, "skipped": 12, "errors": 7}
    assert rows_of(migration.migrated(spark, path, "observation")) == want(60)
    assert {r["id"] for r in migration.errors(spark, path, "observation").collect()} == {i * 3 for i in range(1, 61) if i % 7 == 0 and i % 5}


def test_import_of_what_came_later_and_limits(spark, tmp_path):
    path = str(tmp_path / "m")
    assert migration.migrate(source(spark, 40), path, "observation", taken, batch=10, limit=1).first()["done"] == 1
    assert migration.migrate(source(spark, 40), path, "observation", taken, dry_run=True).first()["left"] == 40 - migration.progress(spark, path).first()["seen"]
    files = set(Path(path).rglob("*.parquet"))
    migration.migrate(source(spark, 40), path, "observation", taken, batch=10)
    migration.migrate(source(spark, 55), path, "observation", taken, batch=10)
    migration.migrate(source(spark, 5), path, "summary", taken, batch=10, from_id=7)
    assert rows_of(migration.migrated(spark, path, "observation")) == want(55)
    assert {r["id"] for r in migration.migrated(spark, path, "summary").collect()} == {9, 12} and files <= set(Path(path).rglob("*.parquet"))
    assert {r["kind"]: (r["ranges"], r["done"], r["seen"]) for r in migration.progress(spark, path).collect()}["summary"] == (1, 1, 3)
    empty = str(tmp_path / "e")
    assert migration.migrate(source(spark, 0), empty, "observation", taken).count() == 0 and migration.migrated(spark, empty, "observation") is None


class Judge:
    """Told apart by files, as it runs in tasks: what it was asked, and what to do."""

    def __init__(self, folder, fails=()):
        self.folder, self.fails = str(folder), tuple(fails)

    def __call__(self, prompts):
        folder = Path(self.folder)
        n = len(list(folder.glob("*.json")))
        (folder / f"{n}-{abs(hash(tuple(prompts)))}.json").write_text(json.dumps(prompts))
        if "raise" in self.fails:
            raise OSError("no network")
        return [None if any(f in p for f in self.fails) else f"grade {len(p) % 4}" for p in prompts]

    def asked(self):
        return [p for f in sorted(Path(self.folder).glob("*.json")) for p in json.loads(f.read_text())]


def test_answers_are_kept(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = [(i, f"prompt {'x' * (i % 5)}") for i in range(20)] + [(99, None)]
    items = spark.createDataFrame(rows, "id long, prompt string")
    for name in "abc":
        (tmp_path / name).mkdir()
    a = Judge(tmp_path / "a", ["xxx"])
    got = {r["id"]: r["reply"] for r in judging.judged(items, F.col("prompt"), F.col("prompt"), a, path).collect()}
    assert got == {i: None if p is None or "xxx" in p else f"grade {len(p) % 4}" for i, p in rows}
    assert sorted(a.asked()) == sorted(["prompt ", "prompt x", "prompt xx"] + ["prompt xxx", "prompt xxxx"] * 3)
    b = Judge(tmp_path / "b")
    got = {r["id"]: r["reply"] for r in judging.judged(items, F.col("prompt"), F.col("prompt"), b, path).collect()}
    assert got == {i: None if p is None else f"grade {len(p) % 4}" for i, p in rows}
    assert sorted(b.asked()) == ["prompt xxx", "prompt xxxx"]
    c = Judge(tmp_path / "c", ["raise"])
    assert {r["id"]: r["reply"] for r in judging.judged(items, F.col("prompt"), F.col("prompt"), c, path).collect()} == got and c.asked() == []
    more = items.union(spark.createDataFrame([(100, "new")], items.schema))
    assert judging.judged(more, F.col("prompt"), F.col("prompt"), c, path).where("id = 100").first()["reply"] is None
    assert judging.judged(more, F.col("prompt"), F.col("prompt"), b, path).where("id = 100").first()["reply"] == "grade 3"
    assert judging.judged(items.limit(0), F.col("prompt"), F.col("prompt"), c, str(tmp_path / "none")).count() == 0


def test_grades(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "q", "text"), (2, "q", "x" * 5000), (3, "q", None), (4, None, "t")], "id int, query string, text string")
    got = {r["id"]: r["grade"] for r in judging.graded(pairs, lambda ps: [str(len(p) % 4) for p in ps], str(tmp_path)).collect()}
    prompt = lambda q, t: len(f"{judging.GRADING}\nQuery: {q}\nDocument:\n{t}") % 4
    assert got[1] == prompt("q", "text") and got[2] == prompt("q", "x" * 2000) and got[3] == prompt("q", "")


def test_themes_are_made_unmade_and_listed(spark, tmp_path):
    names = "id long, title string, session_id string, project_id string, branch string, archived boolean, from_auto long, from_search long, from_drill long, last_surfaced long, created long, type string"
    rec = spark.createDataFrame([(i, f"note {i}", f"s{i % 3}", "p", None, i == 9, i, 1, 0, 100 + i, 50, "change") for i in range(1, 11)], names)
    stars = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (8, 8), (8, 9)], "seed_id long, id long")
    none = spark.createDataFrame([], "cluster_key string, declined_at long")
    reply = lambda ps: ['sure: {"title": "on "two" notes", "narrative": "n", "facts": ["f"], "concepts": []}' if "note 1" in p else "DECLINE" for p in ps]
    now, path = 1_000_000, str(tmp_path / "a")
    created, declines = (df.cache() for df in theme_log.drafted(rec, stars, none, reply, path, now))
    row = created.first()
    assert created.count() == 1 and list(row["member_ids"]) == [1, 2, 3] and row["title"] == 'on "two" notes' and (row["from_auto"], row["last_surfaced"]) == (6, 103)
    assert [tuple(r) for r in declines.collect()] == [("4,5", now)]

    def never(ps):
        raise AssertionError("asked again")

    again, no = theme_log.drafted(rec, stars, declines, never, path, now + 10)
    assert [list(r["member_ids"]) for r in again.collect()] == [[1, 2, 3]] and no.count() == 0
    late, no = theme_log.drafted(rec, stars, declines, never, path, now + 8 * 86400)
    assert [r["cluster_key"] for r in no.collect()] == ["4,5"]
    gone = spark.createDataFrame([], "theme_id long, unmade_at long")
    assert [(r["theme_id"], r["title"]) for r in theme_log.listed(created, gone).collect()] == [(row["theme_id"], row["title"])]
    state = {r["id"]: (r["archived"], r["theme_id"]) for r in theme_log.folded(rec, created, gone).collect()}
    assert state[1] == state[2] == state[3] == (True, row["theme_id"]) and state[4] == (False, None) and state[9] == (True, None) and state[row["theme_id"]] == (False, None)
    back = theme_log.unmade(created, gone, spark.createDataFrame([(row["theme_id"],), (5,), (row["theme_id"],)], "theme_id long"), now + 1)
    gone = gone.union(back).cache()
    assert [tuple(r) for r in gone.collect()] == [(row["theme_id"], now + 1)]
    assert theme_log.unmade(created, gone, gone.select("theme_id"), now + 2).count() == 0 and theme_log.listed(created, gone).count() == 0
    state = {r["id"]: (r["archived"], r["theme_id"]) for r in theme_log.folded(rec, created, gone).collect()}
    assert state[1] == (False, None) and state[9] == (True, None) and state[row["theme_id"]] == (True, None)


ID = "0a1b2c3d-0000-1111-2222-333344445555"
ROLLOUT = [
    {"timestamp": "2024-05-01T10:00:00Z", "type": "session_meta", "payload": {"type": "user_message", "message": "not a turn"}},
    {"timestamp": "2024-05-01T10:00:01Z", "payload": {"type": "agent_message", "message": "hello"}},
    {"timestamp": "2024-05-01T10:00:02Z", "payload": {"type": "user_message", "message": " fix it "}},
    {"payload": {"type": "function_call", "name": "sh", "arguments": '{"cmd":"ls"}'}},
    {"payload": {"type": "custom_tool_call", "input": "y" * 400}},
    {"payload": {"type": "mcp_tool_call_end", "invocation": {"server": "m", "tool": "t", "arguments": {"a": 1}}}},
    {"payload": {"type": "agent_message", "content": [{"type": "x", "text": "one "}, {"text": "two"}, {"n": 1}]}},
    {"timestamp": "2024-05-01T10:00:09Z", "payload": {"type": "patch_apply_end", "stdout": "Success\n M /a/b.py\nA /c d.txt \nD relative\nM /a/b.py"}},
    {"payload": {"type": "reasoning", "message": "no"}},
    {"payload": {"type": "task_complete", "last_agent_message": "done"}},
    {"payload": {"type": "user_message", "message": "thanks"}},
]


def test_compressed_rollouts_equal_plain_ones(spark, tmp_path):
    """Several frames, lines that go over frames and chunks, a broken line, a file that breaks off, one that is none, and an empty one."""
    text = "\n".join(json.dumps(x) for x in ROLLOUT[:5]) + "\r\n{broken\n\n" + "\n".join(json.dumps(x) for x in ROLLOUT[5:])
    plain, packed = tmp_path / "plain" / "2024", tmp_path / "packed" / "2024"
    plain.mkdir(parents=True)
    packed.mkdir(parents=True)
    big = text + "\n" + json.dumps({"payload": {"type": "agent_message", "message": "z" * 3_000_000}})
    z = zstandard.ZstdCompressor()
    for name, body in ((ID, text), ("1" + ID[1:], big), ("2" + ID[1:], "")):
        raw = body.encode()
        (plain / f"rollout-x-{name}.jsonl").write_bytes(raw)
        (packed / f"rollout-x-{name}.jsonl.zst").write_bytes(b"".join(z.compress(raw[i : i + 777_777 if len(raw) > 10**6 else i + 100]) for i in range(0, len(raw), 777_777 if len(raw) > 10**6 else 100)))
    (packed / "other.jsonl").write_text("no rollout\n")
    told = lambda df: sorted(map(str, df.collect()))
    a, b = (rollouts.lines(spark, str(tmp_path / x)) for x in ("plain", "packed"))
    assert told(a.select("n", "line", "error")) == told(b.select("n", "line", "error")) and a.where("error is not null").count() == 0
    assert told(rollouts.turns(rollouts.entries(a))) == told(rollouts.turns(rollouts.entries(b)))
    got = [r for r in rollouts.turns(rollouts.entries(b)).orderBy("prompt_number").collect() if r["session_id"] == ID]
    assert [(r["prompt_number"], r["tool_input_summary"], r["files_modified"]) for r in got] == [(1, "", []), (2, "fix it", ["/a/b.py", "/c d.txt"]), (3, "thanks", [])]
    assert got[1]["tool_result_summary"].split("\n") == ['sh({"cmd":"ls"})', f"tool({'y' * 299}…)", 'm:t({"a":1})', "assistant: one two", "applied a code patch", "result: done"]
    assert got[1]["ts"] == 1714557602 and got[2]["ts"] == 1714557609 and got[0]["tool_result_summary"] == "assistant: hello"
    lines = [f"{i} " + "v" * 2000 for i in range(200)]
    whole = z.compress("\n".join(lines[:150]).encode() + b"\n")
    rest = z.compress("\n".join(lines[150:]).encode())
    for k, body in ((3, whole + b"not a frame at all"), (4, whole + rest[:-20]), (5, b"none")):
        (packed / f"rollout-x-{k}{ID[1:]}.jsonl.zst").write_bytes(body)
    for k, least in ((3, 110), (4, 110), (5, 0)):
        bad = rollouts.lines(spark, str(packed)).where(F.col("path").contains(f"{k}{ID[1:]}")).orderBy("n").collect()
        assert bad[-1]["line"] is None and bad[-1]["error"] and all(r["error"] is None for r in bad[:-1])
        got = [r["line"] for r in bad[:-1]]
        assert len(got) >= least and got[:-1] == lines[: max(0, len(got) - 1)]
