"""Envelopes, pages after collapse, failing legs and evaluation by class, against plain Python."""

from math import log2

import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.byte_pairs import Ranks, encoder
from quarry.operators import context as C
from quarry.operators import evaluation as E
from quarry.operators import passes, search
from quarry.plans import registry, tables

SF = "/root/testdata/sf0.001"


def test_envelopes_of_the_query(spark):
    """The registered query: every hit in its group, in rank order, cut to the budget."""
    got = {r["query_id"]: (r["hits"], r["envelope"]) for r in registry.queries()["envelopes"](spark, SF).collect()}
    docs = sorted((r["id"], r["text"] or "") for r in tables.chunks(spark, SF).collect())
    for q, (n, text) in got.items():
        own = [(i, t) for i, t in docs if i // 12 == q]
        groups = []
        for c, name in enumerate(C.CHANNELS):
            lines = [f"### doc {i} · score {1 / (1 + i):,.2f}\n{t[:600].strip(' ')}" for i, t in own if i % 4 == c]
            groups += [f"## {name}\n" + "\n\n".join(lines)] if lines else []
        body = "\n\n".join(groups)
        assert n == len(own)
        assert text == f"<memory-context>\n{body}\n</memory-context>" or (C.MARKER in text and body.startswith(text.removeprefix("<memory-context>\n").split(C.MARKER)[0]))


def test_inbox_comes_first_and_badges_tell_what_is_saved(spark):
    rows = [(1, 1, "observation", "t1", "one two", 0.5, None, None, None, None, 100), (1, 2, "memory", "t2", "s2", 0.4, None, None, None, None, None), (1, 3, "remote", "ignored", " body ", 0.1, True, "ann", "noon", None, 50),
            (1, 4, "memory", "2 unread", "x", 0.1, True, None, None, True, None), (1, 5, "skill", "t5", "s5", 0.2, False, None, None, None, 5), (1, 6, "memory", "-", "b", 0.1, True, None, "", None, None)]
    h = spark.createDataFrame(rows, "query_id int, rank int, channel string, title string, snippet string, score double, inbox boolean, sender string, sent string, inbox_summary boolean, work_tokens long")
    text = C.envelopes(h).first()["envelope"]
    count = lambda s: len(regex.findall(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]", s))
    line = "### t1 · score 0.50\none two"
    saved = int((100 - count(line)) * 100 / 100 + 0.5)
    assert text == "<memory-context>\n### 📨 ann · noon\nbody\n\n2 unread\n\n### 📨 peer\nb\n\n## memory\n### t2 · score 0.40\ns2\n\n## skill\n### t5 · score 0.20\ns5\nsaved 0%\n\n## observation\n" + line + f"\nsaved {saved}%\n</memory-context>"
    ranks = Ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    short = C.envelopes(h, 20, ranks).first()["envelope"].removeprefix("<memory-context>\n").removesuffix("\n</memory-context>")
    assert short.endswith(C.MARKER) and len(encoder(ranks)(short)) <= 20


@pytest.mark.parametrize(("sort", "offset", "limit"), [("total", 0, 7), ("total", 5, 10), ("recency", 3, 8), ("from_search", 0, 300)])
def test_pages_after_collapse(spark, sort, offset, limit):
    o = tables.observations(spark, SF)
    got, matched = passes.collapsed_page(o, sort, "surfaced", offset=offset, limit=limit, titles=0.4)
    tokens = {r["id"]: set(r["t"]) for r in o.select("id", T.significant_tokens(F.col("title")).alias("t")).collect()}
    rows = [r.asDict() for r in o.collect() if not r["archived"]]
    for r in rows:
        r["total"] = r["from_auto"] + r["from_search"] + r["from_drill"]
    rows = [r for r in rows if r["total"] > 0]
    key = lambda r: (-(r["last_surfaced"] or 0) if sort == "recency" else -r[sort], -(r["last_surfaced"] or 0), -r["id"])
    groups: list = []
    for r in sorted(rows, key=key)[: max(200, offset + limit)]:
        a = tokens[r["id"]]
        for g in groups:
            b = tokens[g[0]["id"]]
            if a | b and round(len(a & b) / len(a | b), 6) >= 0.4:
                g.append(r)
                break
        else:
            groups.append([r])
    folded = [{"id": g[0]["id"], "title": g[0]["title"], "variants": len(g), "last_surfaced": max((r["last_surfaced"] for r in g if r["last_surfaced"]), default=None)} | {c: sum(r[c] for r in g) for c in ("from_auto", "from_search", "from_drill", "total")} for g in groups]
    want = sorted(folded, key=key)[offset : offset + limit]
    assert matched == len(rows) and [r["id"] for r in got.collect()] == [w["id"] for w in want]
    assert [(r["variants"], r["total"]) for r in got.collect()] == [(w["variants"], w["total"]) for w in want]


def test_a_leg_that_fails_leaves_the_other(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue hen")], "id long, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(7, "fox", [0.0, 1.0])], "query_id int, query string, vector array<float>")

    def broken():
        raise OSError("no index")

    def breaks_later():
        return search.knn(v, q, 2).withColumn("score", F.raise_error(F.lit("lost while it ran")).cast("double"))

    keyword = lambda: search.bm25(docs, q, 2)
    for bad, text in ((broken, "no index"), (breaks_later, "lost while it ran")):
        legs, why = search.isolated({"vector": bad, "keyword": keyword})
        assert list(why) == ["vector"] and text in why["vector"]
        assert [r["id"] for r in search.hybrid(docs, v, q, legs=legs).collect()] == [1]
    legs, why = search.isolated({"vector": lambda: search.knn(v, q, 2), "keyword": keyword})
    rows = lambda df: [tuple(r) for r in df.orderBy("rank").collect()]
    assert why == {} and rows(search.hybrid(docs, v, q, legs=legs)) == rows(search.hybrid(docs, v, q))
    with pytest.raises(RuntimeError):
        search.isolated({"vector": broken, "keyword": broken})


def test_report_by_class(spark):
    """Against plain loops: misses, ties of freshness, entities in any case, grades that are missing."""
    golden = [(1, "lookup", None), (2, "temporal", "Fox"), (3, "temporal", "hen"), (4, "concept", "x"), (5, "temporal", None), (6, "temporal", "nothing")]
    results = [("a", q, r, q * 10 + (r * 7 + q) % 12, f"text {'FOX' if (r + q) % 3 == 0 else ''} {'hen' if r % 2 else ''}", (r * 5 + q) % 4) for q in (1, 2, 3, 5, 6) for r in range(1, 13)]
    results += [("b", q, r, q * 10 + r, "a fox" if r < 3 else "hen", r) for q in (1, 2, 4) for r in (1, 2, 3)]
    grades = [(q, i, i % 4) for _, q, r, i, *_ in results if q in (1, 4) and r != 2]
    grades = list(dict.fromkeys(grades))
    got = {r["profile"]: r.asDict() for r in E.report(spark.createDataFrame(results, "profile string, query_id int, rank int, id int, text string, created int"), spark.createDataFrame(golden, "query_id int, class string, entity string"), spark.createDataFrame(grades, "query_id int, id int, grade int")).collect()}
    grade = {(q, i): g for q, i, g in grades}
    mean = lambda x: sum(x) / len(x) if x else 0.0
    for p in "ab":
        m = {k: [] for k in ("mrr", "ndcg5", "ndcg10", "recall10", "freshness", "staleness")}
        for q, kind, entity in golden:
            hits = sorted((r[2:] for r in results if r[0] == p and r[1] == q and r[2] <= 10))
            if kind == "temporal":
                if entity:
                    own = [h for h in hits if entity.lower() in h[2].lower()]
                    best = max(own, key=lambda h: (h[3], -h[0]), default=None)
                    m["freshness"].append(float(best is not None and best[0] == 1))
                    m["staleness"].append((len(own) - 1) / len(hits) if best else 0.0)
                continue
            gs = [grade.get((q, h[1]), 0) for h in hits]
            m["mrr"].append(next((1 / (i + 1) for i, g in enumerate(gs) if g >= 2), 0.0))
            dcg = lambda g, k: sum((2**x - 1) / log2(i + 2) for i, x in enumerate(g[:k]))
            for k in (5, 10):
                ideal = dcg(sorted(gs, reverse=True), k)
                m[f"ndcg{k}"].append(dcg(gs, k) / ideal if ideal else 0.0)
            m["recall10"].append(1.0 if any(g >= 2 for g in gs) else 0.0)
        assert got[p]["n"] == 6 and got[p]["n_temporal"] == 3
        for k, x in m.items():
            assert abs(got[p][k] - mean(x)) < 1e-9, (p, k)


def test_profiles_search_once(spark, monkeypatch):
    """Both profiles' rows are those of each by itself, and each leg is searched for once."""
    from quarry.operators import passes, search
    from quarry.plans import registry
    from quarry.plans import tables as X

    sf, calls = "/root/testdata/sf0.01", []
    docs, vectors, asked = X.chunks(spark, sf), X.vectors(spark, sf), X.asked_twice(spark, sf)
    rows = lambda df: {(r["query_id"], r["rank"], r["id"]) for r in df.collect()}
    each = {"legacy": rows(search.hybrid(docs, vectors, asked, 10, search.LEGACY)), "v2": rows(search.hybrid(docs, vectors, asked, 10))}
    for name in ("knn", "bm25"):
        monkeypatch.setattr(search, name, lambda *a, f=getattr(search, name), n=name, **b: (calls.append(n), f(*a, **b))[1])
    found = registry.queries()["profile_results"](spark, sf)
    for name, want in each.items():
        assert rows(found.where(found["profile"] == name)) == want and want
    assert sorted(calls) == ["bm25", "knn"] and passes
