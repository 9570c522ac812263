"""WARC round trips, chats, decontamination, the mix and the pipeline."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, decontaminate, mixing, queries, quality, warc
from quarry.llm.scratch import land

from .conftest import by_row, sha

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert by_row(df.select(*names).collect()) == by_row(cur.fetchall())


def test_warc(spark):
    big, rows = "ä" * 600, []
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "x\r\ny z", None), (None, "n", big), (2, "http://b/", big), (7, "", "<p>\r\n\r\nWARC/1.1\r\n</p>")]
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, offset long").repartition(3)
    where, index = warc.write_archives(pages)
    got = warc.verified(warc.read_records(where, index)).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        old = h == big and i != 3
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if old else "response", 3 if old else None))
    assert by_row((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == by_row(want)
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {big.encode(), b"small", b"", rows[-1][2].encode()}
    some = index.where("page_id in (3, 6)")
    assert sorted(r["url"] for r in warc.read_records(where, some).collect()) == ["", "x y z"]
    assert warc.read_records(*warc.write_archives(pages.limit(0))).count() == 0
    for p in (warc.WarcParams(gap=0, most=1), warc.WarcParams(gap=0), warc.WarcParams(most=700), warc.WarcParams(task_bytes=100)):
        again = warc.verified(warc.read_records(where, index, p)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    # each file begins with a warcinfo record, and members follow one another without gaps
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(where)
    for file, own in {r["file"]: sorted((x["offset"], x["length"]) for x in index.collect() if x["file"] == r["file"]) for r in index.select("file").distinct().collect()}.items():
        raw = store.open_input_file(f"{root}/{file}").read()
        assert warc.parse_record(raw[: own[0][0]])["warc-type"] == "warcinfo"
        assert [a + n for a, n in own] == [*(a for a, _ in own[1:]), len(raw)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5) | st.sampled_from(chat.CONTROL), st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "x", "é", "<|", "end|>"])))))
def test_chat_round_trip(turns):
    f = chat.Flatten()
    for role, bits in turns:
        f.turn(role, [chat.Part("text", b) for b in bits])
    text = "".join(f.out)
    assert chat.read_back(text) == [(r, "".join(b)) for r, b in turns]
    for mark in chat.CONTROL:
        assert text.count(mark) == (len(turns) if mark in (chat.TURN, chat.BODY, chat.END) else 0)


def test_chats(spark):
    rows = [(1, 1, "assistant", "b \\ <|end|>"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "é\n"), (None, None, "user", "first"), (1, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, spans int, formatted string")
    want = []
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want.append((c, len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss)))
    got = chat.digests(chat.format_chats(df)).collect()
    assert by_row(tuple(r)[:5] for r in got) == by_row(want)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <|", None, None, None, None, None), ("text", "image|>", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)]), (1, 1, "assistant", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert [(a["kind"], a["uri"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 768)]
    assert all(r["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in r["attachments"]) and r["formatted"].count("<|image|>") == 1
    with pytest.raises(Exception):
        chat.Flatten().turn("user", [chat.Part("video")])


def edit_distance(a, b):
    """Of a and the nearest part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    items = [" ".join(word() for _ in range(20)) for _ in range(6)] + ["short", None, ""]
    docs = []
    for i in range(40):
        t = list((items[i % 6] if i % 2 else " ".join(word() for _ in range(20))))
        for _ in range(i // 3):
            k = int(rng.integers(len(t)))
            kind = rng.integers(3)
            t[k : k + 1] = [] if kind == 0 else ["z"] if kind == 1 else [t[k], "y"]
        docs.append((i, f"{word()} {word()}\n" + "".join(t).upper() + "\t" + word() + " short"))
    docs += [(100, None), (101, ""), (102, items[0] + " " + items[1]), (None, items[2])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    fold = lambda t: decontaminate.folded(np.frombuffer(t.encode(), np.uint8)).tobytes().decode()
    want = {}
    for i, t in docs:
        for k, s in enumerate(items[:6]):
            e = edit_distance(fold(s), fold(t or ""))
            if e <= int(len(s) * 0.1):
                want[i, k] = e
    got = decontaminate.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and any(want.values())
    for p in (decontaminate.GramParams(), decontaminate.GramParams(block_mb=0.0005, pairs=50)):
        left = decontaminate.without_benchmark(d, b, p).collect()
        assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted(i for i, _ in docs if i is not None and not any(i == x for x, _ in want))
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_of_runs():
    """A MiB of blanks, and dashes, against items of blanks and dashes: bounded memory, and the best places by brute force."""
    import tracemalloc

    items = [b" " * 200, b"-" * 60 + b" " * 140, b"-" * 200, b"0" * 40, b"-" * 30 + b"x" * 10 + b"-" * 30]
    texts = [b" " * (1 << 20), b" " * 300 + b"-" * 66 + b" " * 500, b"-" * 199 + b"y" + b" " * 135, b"000 " * 30, b"-" * 33 + b"x" * 9 + b"-" * 31, b""]
    p = decontaminate.GramParams()
    found = decontaminate.index(list(range(len(items))), items, p)
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    tracemalloc.start()
    got = decontaminate.matches(found, data, offs, decontaminate._table(found, p), p)
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()
    want = {(0, 0): 0}
    for t in range(1, len(texts)):
        for i, s in enumerate(items):
            e = edit_distance(s, texts[t])
            if e <= found.budget[i]:
                want[t, i] = e
    assert {(t, i): e for t, i, e, _, _ in got} == want and len(want) == 6
    for t, i, e, a, b in got:
        assert edit_distance(items[i], texts[t][a:b]) == e and abs(b - a - len(items[i])) <= e


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=33, max_size=70), st.lists(st.text("ab ", max_size=90), min_size=1, max_size=4), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "c", "ab"])), max_size=6))
def test_decontamination_against_brute_force(item, texts, edits):
    changed = list(item)
    for at, put in edits:
        changed[at : at + 1] = [put]
    texts = [*texts, "b" + "".join(changed) + " a"]
    p = decontaminate.GramParams(pairs=100)
    found = decontaminate.index([0], [item.encode()], p)
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = {t: e for t, _, e, _, _ in decontaminate.matches(found, data, offs, decontaminate._table(found, p), p)}
    assert got == {t: e for t, x in enumerate(texts) if (e := edit_distance(item, x)) <= found.budget[0]}


def fill(sizes, weights):
    """Targets by sharing again and again."""
    total, target, left = sum(sizes.values()), {}, dict(weights)
    rest = total
    while left:
        unit = rest / sum(left.values())
        full = [s for s in left if sizes[s] * 3 < unit * left[s]]
        if not full:
            return target | {s: unit * w for s, w in left.items()}
        for s in full:
            target[s] = sizes[s] * 3
            rest -= sizes[s] * 3
            del left[s]
    return target


def test_mix(spark, docs):
    got = mixing.mixed(docs).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert by_row((r["doc_id"], r["taken"]) for r in mixing.mixed(docs.repartition(3)).collect()) == by_row((r["doc_id"], r["taken"]) for r in got)
    out = mixing.emitted(docs)
    assert out.count() == sum(r["copies"] for r in got) and out.columns == [*docs.columns, "copy"]
    shuffled = mixing.mixed(docs, mixing.MixParams(broadcast_sources=0)).collect()
    assert by_row((r["doc_id"], r["taken"]) for r in shuffled) == by_row((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline(spark):
    from quarry.llm import minhash_dedup

    from .test_pairs import brute
    from .test_repeats import brute_bytes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(land(stage(spark, seen[-1], SF), "test"))
    assert all(d.columns == columns for d in seen[:-1]) and seen[-1].columns == [*columns, "copy"]
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in quality.score(docs, net).where("quality_score >= 0.3").collect()}
    texts = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in seen]
    assert ids[2] == {r[0] for r in brute(texts[1], minhash_dedup.SketchParams().shingle) if r[3]}
    left = {r[0]: r[4] for r in brute_bytes(texts[2], corpus_pipeline.PASSAGE_BYTES, keep_one=True) if r[1] > r[2]}
    assert ids[3] == set(left) and all(sha(t) == left[i] for i, t in texts[3] if t.isascii())
    items = [decontaminate.folded(np.frombuffer(r["text"].encode(), np.uint8)).tobytes() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, t in texts[3] if any(s in decontaminate.folded(np.frombuffer(t.encode(), np.uint8)).tobytes() for s in items)}
    assert ids[4] == ids[3] - held
    due = {r["doc_id"]: r["copies"] for r in mixing.mixed(seen[4]).collect()}
    got = {r["doc_id"]: r["n"] for r in seen[5].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in due.items() if n}


def test_near_dedup_keeps_one_row(spark):
    """Rows ingested twice and rows without an id, copies and near copies: one each, and the byte stage then leaves it whole."""
    rng = np.random.default_rng(8)
    a, b, c, d, e = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120)) for _ in range(5))
    rows = [(1, a), (1, a), (2, b), (2, b), (3, b + " more"), (None, c), (None, c), (None, c + " more"), (None, d), (4, d + " more"), (5, e), (6, ""), (6, ""), (7, ""), (None, None), (5, "of one id")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = land(corpus_pipeline.near_dedup(spark, docs, SF), "test")
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=str)
    want = [(1, a), (2, b), (0, d), (5, e), (6, ""), (7, ""), (0, None), (5, "of one id")]
    assert [x for x in got if x not in want] in ([(0, c)], [(0, c + " more")]) and sorted((x for x in got if x in want), key=str) == sorted(want, key=str)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_bytes(spark, kept, SF).collect()]
    assert by_row(left) == by_row(map(tuple, kept.select("doc_id", "text").collect()))


def test_passages_of_over_50_words(spark):
    """Passages of 51 to 70 words stay in the document of the smallest id alone, and what stands around them stays."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmno"), int(rng.integers(3, 8)))) for _ in range(n))
    rows, want = [], {}
    for i, n in enumerate(range(51, 71)):
        passage = prose(n)
        for k in range(5):
            head, tail = prose(80), prose(60)
            rows.append((100 * k + i, f"{head} {passage} {tail}"))
            want[100 * k + i] = (head, passage if k == 0 else "", tail)
    docs = spark.createDataFrame([(i, t, "en", None, len(t), "x", 1) for i, t in rows] + [(None, None, None, None, None, "y", 2)], "doc_id long, text string, lang string, source string, n_chars long, id string, t1 int").repartition(3)
    got = corpus_pipeline.repeated_bytes(spark, docs, SF).collect()
    assert len(got) == len(rows) + 1 and [r["text"] for r in got if r["doc_id"] is None] == [None]
    for r in got:
        if r["doc_id"] is not None:
            head, passage, tail = want[r["doc_id"]]
            # neighbouring bytes that agree by chance may go with the passage
            assert r["text"].startswith(head[:-3]) and r["text"].endswith(tail[3:]) and r["n_chars"] == len(r["text"])
            assert (passage in r["text"]) if passage else len(r["text"]) <= len(head) + len(tail) + 2
    assert corpus_pipeline.repeated_bytes(spark, docs.limit(0), SF).count() == 0


def test_stages_with_nulls_ties_and_clashing_columns(spark, tmp_path):
    """Every stage by itself: nulls in any column, repeated rows, columns with names that the operators use, and an empty table."""
    rng = np.random.default_rng(10)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmno"), int(rng.integers(3, 8)))) for _ in range(n))
    a, b = prose(90), prose(90)
    rows = [(1, a, "en", "s", 5), (1, a, "en", "s", 5), (2, b, None, None, None), (None, prose(50), None, "s", 7), (None, None, None, None, None), (3, "", "de", "t", 0), (4, "held item of a benchmark, forty bytes long", "en", "t", 43)]
    extra = "text2 string, size long, kept string, t1 long, id string, group int, copy int, quality_score double"
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3, 4, 0.5) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(2)
    spark.createDataFrame([(0, "held item of a benchmark, forty bytes long"), (None, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, None), (77, None, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    base = [r[:5] for r in rows]
    want = {
        "quality classifier": base,  # learnt from good ones alone
        "MinHash near-dedup": base[1:],
        "suffix-array dedup": base,  # rows repeated in full are one text here
        "benchmark decontamination": base[:-1],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        columns = list(corpus_pipeline.COLUMNS)
        assert got.columns == (columns if name in want else [*columns, "copy"])
        if name in want:
            assert by_row(got.collect()) == by_row(want[name]), name
        else:
            assert {r["doc_id"] for r in got.collect()} <= {r[0] for r in rows}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_short_items(spark, tmp_path):
    """Items of a few bytes are found where they stand as words, in the query and in the pipeline's stage."""
    items = ["Who wrote Emma?", "who wrote", "谁写了红楼梦", "née", "x", " \n", "", None, "Who wrote Emma?", "the capital of France is Paris, and", "[a]"]
    texts = [
        "asked: WHO\twrote Emma?", "who wrotes Emmas?", "问题谁写了红楼梦呢", "“née”", "renée néer", "y x.", "xx x_ 2x", "Who wrote Emma", "", None, "the capital of France is Paris,  and", "Emma?Who wrote Emma?Who", "z[a]z", "x", "née x́",
    ]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {(0, 0), (0, 8), (0, 1), (2, 2), (3, 3), (5, 4), (7, 1), (10, 9), (11, 0), (11, 8), (11, 1), (12, 10), (13, 4)}
    got = queries.op3_decontamination(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    for r in got:
        if r["item_id"] != 9:
            part = texts[r["doc_id"]].encode()[r["begin"] : r["end"]].decode()
            assert r["edits"] == 0 and part.lower().replace("\t", " ") == items[r["item_id"]].lower()
    left = corpus_pipeline.benchmark_filter(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in left} == set(range(len(texts))) - {i for i, _ in want}
