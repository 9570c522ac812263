"""Queries without SQL against plain Python over their collected inputs, at a scale at which each returns rows."""

import itertools
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import passes as P
from quarry.operators import search as H
from quarry.operators import semantic as G
from quarry.operators import similarity as M
from quarry.plans import core, more, registry
from quarry.plans import tables as X

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return registry.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def records(spark):
    o = X.observations(spark, SF).withColumn("toks", T.significant_tokens(F.col("title")))
    rows = [r.asDict() | {"total": r["from_auto"] + r["from_search"] + r["from_drill"], "toks": set(r["toks"])} for r in o.collect()]
    return sorted(rows, key=lambda r: (-r["total"], r["id"]))


def by(rows, *columns):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[c] for c in columns)].append(r)
    return out.values()


def greedy(rows, least, guard=True):
    """Seeds in order: a record joins the first one that fits."""
    out = {}
    for scope in by(rows, "project_id", "branch"):
        seeds = []
        for r in scope:
            for s in seeds:
                if r["toks"] and len(r["toks"] & s["toks"]) >= least * len(r["toks"] | s["toks"]) and (not guard or M.may_merge(r["title"], s["title"])):
                    out[r["id"]] = s["id"]
                    break
            else:
                seeds.append(r)
                out[r["id"]] = r["id"]
    return out


def joined(groups):
    return {(i, s) for i, s in groups.items() if i != s}


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))


def stars(rows, near, scope, sessions):
    """Greedy stars: an unclaimed record takes its unclaimed neighbours."""
    out = set()
    for group in by(rows, *scope):
        claimed = set()
        for r in group:
            if r["id"] in claimed:
                continue
            star = [r] + [o for o in group if o["id"] != r["id"] and o["id"] not in claimed and near(r, o) and M.may_merge(r["title"], o["title"])]
            if len(star) >= 2 and len({o["session_id"] for o in star}) >= sessions:
                claimed.update(o["id"] for o in star)
                out.update((r["id"], o["id"]) for o in star)
    return out


def test_title_groups(spark, records):
    got = {r["id"]: r["seed_id"] for r in run(spark, "title_groups").collect()}
    want = greedy(records, 0.5)
    assert joined(got) == joined(want) and joined(want)
    assert all(want[i] == s for i, s in got.items())


def test_groups_of_many_titles(spark):
    """Titles with versions, identifiers, denials and other order of words, ties of totals, and null scopes."""
    ends = ["", " 1", " 1 2", " 2", " v1.2", " v1.3", " v1.2 1", " fails", " A", " a.py", " a.py B"]
    heads = ["alpha beta", "beta alpha", "alpha beta gamma", "gamma delta", "delta gamma alpha", "of the"]
    titles = [h + e for h, e in itertools.product(heads, ends)] * 2
    rows = [(i, t, ("p", None)[i % 2], None if i % 3 else "b", i * 7 % 5, 0, i % 2) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, title string, project_id string, branch string, from_auto long, from_search long, from_drill long")
    toks = {r["id"]: set(r["t"]) for r in df.select("id", T.significant_tokens(F.col("title")).alias("t")).collect()}
    plain = [{"id": r[0], "title": r[1], "project_id": r[2], "branch": r[3], "total": r[4] + r[6], "toks": toks[r[0]]} for r in rows]
    plain.sort(key=lambda r: (-r["total"], r["id"]))
    for guard, least in ((True, 0.5), (True, 1.0), (False, 0.3)):
        got = {r["id"]: r["seed_id"] for r in M.title_groups(df, least, guard=guard).collect()}
        assert joined(got) == joined(greedy(plain, least, guard)), (guard, least)
    assert M.title_groups(df.limit(0)).count() == 0


def test_stars_wait_for_earlier_ones(spark):
    """A long row of neighbours, a hub, and stars that are too small in sessions."""
    n = 26
    rows = [(i, f"t {chr(97 + i % 3)}", "p", None, ("s", None, "t")[i // 2 % 3], n - i if i % 5 else 3, 0, 0, False) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, title string, project_id string, branch string, session_id string, from_auto long, from_search long, from_drill long, is_anchored boolean")
    pairs = {(i, i + 1) for i in range(n - 1)} | {(4, i) for i in range(16, 22)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    plain = sorted(({"id": r[0], "title": r[1], "session_id": r[4], "total": r[5], "one": 1} for r in rows), key=lambda r: (-r["total"], r["id"]))
    near = lambda x, y: (x["id"], y["id"]) in pairs or (y["id"], x["id"]) in pairs
    for sessions in (1, 2):
        got = {(r["seed_id"], r["id"]) for r in G._greedy(df, edges, sessions).select("seed_id", "id").collect()}
        assert got == stars(plain, near, ("one",), sessions) and got
    assert G._greedy(df, edges.limit(0), 1).count() == 0


def test_collapsed_titles(spark, records):
    groups = greedy(records, 0.3, guard=False)
    want = defaultdict(lambda: [0, 0, 0])
    for r in records:
        w = want[groups[r["id"]]]
        w[0], w[1], w[2] = w[0] + r["total"], w[1] + 1, max(w[2], r["last_surfaced"] or 0)
    assert {r["id"]: [r["total"], r["variants"], r["last_surfaced"] or 0] for r in run(spark, "collapsed_titles").collect()} == dict(want)


def test_dedup_pass(spark, records):
    v = {r["id"]: r["vector"] for r in more._alike(spark, SF).collect()}
    known = {r["id"]: r for r in records}
    groups = joined(greedy([r for r in records if not r["archived"]], 0.5))
    want = {(s, i) for i, s in groups if not known[i]["from_drill"] and not known[i]["is_anchored"] and i in v and s in v and cosine(v[i], v[s]) >= 0.95}
    assert {(r["survivor_id"], r["id"]) for r in run(spark, "dedup_pass").collect()} == want and want


def test_semantic_folds(spark, records):
    v = {r["id"]: r["vector"] for r in more._alike(spark, SF).collect()}
    near = lambda x, y: x["id"] in v and y["id"] in v and cosine(v[x["id"]], v[y["id"]]) >= 0.95
    rows = [r | {"session_id": r["project_id"]} for r in records]
    want = stars(rows, near, ("session_id", "project_id", "branch"), 1)
    assert {(r["seed_id"], r["id"]) for r in run(spark, "semantic_folds").collect()} == want and want


def test_theme_clusters(spark, records):
    v = {r["id"]: r["vector"] for r in more._alike(spark, SF, 15).collect()}
    co = {(r["a"], r["b"]) for r in core._similar(spark, SF, hours=168).collect() if r["co"] >= 0.02}
    near = lambda x, y: tuple(sorted((x["id"], y["id"]))) in co and x["id"] in v and y["id"] in v and cosine(v[x["id"]], v[y["id"]]) >= 0.93
    free = [r for r in records if not r["from_drill"] and not r["is_anchored"]]
    want = stars(free, near, ("project_id", "branch"), 2)
    assert {(r["seed_id"], r["id"]) for r in run(spark, "theme_clusters").collect()} == want and want


def dbscan(ids, near, least):
    beside = {i: {j for j in ids if i == j or (min(i, j), max(i, j)) in near} for i in ids}
    core_ids = {i for i in ids if len(beside[i]) >= least}
    label = {}
    for i in sorted(core_ids):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = i
                stack += beside[j] & core_ids
    return {i: (label.get(i, min((label[j] for j in beside[i] & core_ids), default=None)), i in core_ids) for i in ids}


def test_dream_clusters(spark):
    pairs = core._similar(spark, SF).collect()
    ids = {r[s] for r in pairs for s in "ab"}
    near = {(r["a"], r["b"]) for r in pairs if 1 - 0.625 * r["co"] - 0.375 * r["time"] <= 0.35}
    assert {r["id"]: (r["cluster"], r["is_core"]) for r in run(spark, "dream_clusters").collect()} == dbscan(ids, near, 3)


def test_clusters_of_use(spark):
    """Two clusters, a point at the border of both, and noise, with what use_report tells of them."""
    near = {(1, 2), (1, 3), (2, 3), (3, 20), (11, 12), (11, 13), (12, 13), (13, 20)}
    ids = [1, 2, 3, 11, 12, 13, 20, 30]
    points = spark.createDataFrame([(i,) for i in ids], "id long")
    distances = spark.createDataFrame([(a, b, 0.35) for a, b in near] + [(20, 30, 0.36)], "a long, b long, distance double")
    for least in (2, 3, 4):
        got = {r["id"]: (r["cluster"], r["is_core"]) for r in M.dbscan(points, distances, least=least).collect()}
        assert got == dbscan(ids, near, least)
    created = points.select("id", (F.col("id") * 86400).alias("created"))
    report = {r["cluster"]: (r["members"], r["cores"], r["span_days"]) for r in P.use_report(points, distances, created, least=4).collect()}
    assert report == {3: (4, 1, 19.0), 13: (3, 1, 2.0), None: (1, 0, 0.0)}


def ranked(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["id"])
    return dict(out)


def test_search_by_channel(spark):
    docs = X.chunks(spark, SF)
    channel = {r["id"]: r["channel"] for r in docs.select("id", "channel").collect()}
    full = ranked(H.hybrid(docs, X.vectors(spark, SF), X.asked_twice(spark, SF), 2 * H.RankProfile().per_leg))
    want = {q: kept[:5] for q, ids in full.items() if (kept := [i for i in ids if channel.get(i) == "en"])}
    assert ranked(run(spark, "search_by_channel")) == want and want


def test_split_chunks(spark):
    """Pieces are numbered, all of them are counted, and no word is lost."""
    from quarry.sources import chunkers

    counts = {r["id"]: r["pieces"] for r in run(spark, "split_chunks").collect()}
    texts = {r["id"]: r["text"] for r in X.chunks(spark, SF).collect()}
    got = defaultdict(dict)
    for r in chunkers.split_for_limit(X.chunks(spark, SF), 512).collect():
        got[r["id"]][r["split_index"]] = r["text"]
        assert r["split_total"] == counts[r["id"]]
    assert {i: len(p) for i, p in got.items()} == counts and max(counts.values()) > 1
    for i, parts in got.items():
        assert sorted(parts) == list(range(len(parts)))
        assert set(re.findall(r"\S+", texts[i] or "")) <= {w for p in parts.values() for w in re.findall(r"\S+", p)}


def test_semantic_folds_of_copies(spark, records):
    """Many records of few vectors and titles: the same stars as in plain Python, and no pairs of copies are written."""
    from quarry.operators import scratch

    wide = [r | {"id": 10_000 * k + r["id"], "session_id": "p", "project_id": "p", "branch": None, "total": r["total"] + k % 3, "from_auto": r["from_auto"] + k % 3, "title": ("not " if k % 2 else "") + r["title"]} for k in range(8) for r in records]
    v = {r["id"]: [float(r["id"] % 4 + 1), 0.3 * (r["id"] % 5), -0.0 if r["id"] % 2 else 0.0] for r in wide if r["id"] % 50}
    v |= {r["id"]: [0.0, 0.0, 0.0] for r in wide if r["id"] % 50 == 7}
    near = lambda x, y: x["id"] in v and y["id"] in v and any(v[x["id"]]) and any(v[y["id"]]) and cosine(v[x["id"]], v[y["id"]]) >= 0.95
    wide.sort(key=lambda r: (-r["total"], r["id"]))
    want = stars(wide, near, ("session_id", "project_id", "branch"), 1)
    names = ["id", "title", "session_id", "project_id", "branch", "from_auto", "from_search", "from_drill"]
    rows = spark.createDataFrame([tuple(r[c] for c in names) for r in wide], "id long, title string, session_id string, project_id string, branch string, from_auto long, from_search long, from_drill long")
    at = len(scratch._made)
    found = G.semantic_folds(rows, spark.createDataFrame(list(v.items()), "id long, vector array<double>"))
    assert {(r["seed_id"], r["id"]) for r in found.collect()} == want and len(want) > 500
    assert all(spark.read.parquet(p).count() <= 4 * len(wide) for p in scratch._made[at:])
