"""Similar titles and records: edges, order-dependent grouping in rounds over edges, and clusters over edges."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.components import connected_components
from quarry.operators.scratch import land

#: fixed values: words that assert an absence
NEGATION = (
    "missing", "absent", "absence", "fails", "failing", "failed", "fail",
    "broken", "none", "empty", "removed", "deleted", "disabled", "off",
    "false", "unavailable", "cannot", "without", "lacks", "lacking", "no", "not",
)
_CONTRACTION = re.compile(r"[a-z]+n['’]t(?![A-Za-z0-9_])")
_W0, _W1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: fixed values: what tells instances apart in a title; each kind is looked for in what the ones before left
_IDENTIFIERS = [
    re.compile(_W0 + r"[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*\.[a-z][a-z0-9]{1,4}" + _W1, re.IGNORECASE),
    re.compile(r"#[0-9]+" + _W1),
    re.compile(_W0 + r"[0-9]+(?:\.[0-9]+)+" + _W1),
    re.compile(_W0 + r"[0-9]+\s?(?:[a-z]{1,3}|%)" + _W1, re.IGNORECASE),
    re.compile(_W0 + r"[0-9]+" + _W1),
    re.compile(_W0 + r"[A-Z]{2,}" + _W1),
    re.compile(_W0 + r"[A-Z]" + _W1),
]
_VERSION = _IDENTIFIERS[2]


def identifiers(title: str) -> set[str]:
    found = set()
    for pattern in _IDENTIFIERS:
        found.update(m.lower() for m in pattern.findall(title))
        title = pattern.sub(lambda m: " " * len(m[0]), title)
    return found


def denies(title: str) -> bool:
    low = title.lower()
    return bool(_CONTRACTION.search(low)) or not set(re.split("[^a-z0-9]+", low)).isdisjoint(NEGATION)


def may_merge(a: str, b: str) -> bool:
    """False if one title denies and the other doesn't, if both name versions and not the same ones, or if both have identifiers and none in common."""
    if denies(a) != denies(b):
        return False
    va, vb = set(_VERSION.findall(a)), set(_VERSION.findall(b))
    if va and vb and va != vb:
        return False
    ia, ib = identifiers(a), identifiers(b)
    return not (ia and ib and ia.isdisjoint(ib))


def title_classes(records: DataFrame, scope: tuple[str, ...] = ("project_id", "branch")) -> DataFrame:
    """(kind, scope..., toks, members): records of one scope with equal significant tokens, named by the least id."""
    rows = records.select("id", *scope, F.array_sort(T.significant_tokens(F.col("title"))).alias("toks")).where(F.size("toks") > 0)
    return rows.groupBy(*scope, "toks").agg(F.min("id").alias("kind"), F.count("*").alias("members"))


def title_pairs(records: DataFrame, least: float = 0.5, scope: tuple[str, ...] = ("project_id", "branch")) -> DataFrame:
    """(a, b, similarity), a < b, of title classes of one scope whose token sets have a Jaccard similarity of `least`.

    Two sets this similar share one of their rarest tokens: of n tokens, in a fixed order, one of the first
    n - ceil(least * n) + 1; so the join is by scope and such a token, not of all pairs. Copies stay in their class.
    """
    kinds = title_classes(records, scope)
    freq = kinds.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    tok = kinds.select("kind", *scope, "toks", F.explode("toks").alias("t")).join(freq, "t")
    n = F.size("toks")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("df", "t"))
    head = tok.withColumn("r", place).where(F.col("r") <= n - F.ceil(n * F.lit(least)) + 1).select("kind", *scope, "toks", "t")
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.kind") < F.col("y.kind"))
    for c in scope:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = head.alias("x").join(head.alias("y"), on)
    similarity = F.round(T.jaccard(F.col("x.toks"), F.col("y.toks")), 6)
    return both.select(F.col("x.kind").alias("a"), F.col("y.kind").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= least).distinct()


def first_seeds(edges: DataFrame) -> DataFrame:
    """(id, seed) of the ends of edges (lo, lo_t, hi), where lo comes before hi and (lo_t, lo) is its place: a node beside no earlier
    seed is a seed, others go to the earliest seed beside them.

    Each round makes seeds of nodes without an earlier neighbour and takes what is beside them away, so a long row of nodes, each
    beside the one before, needs a round for every second node. Rounds are written to the scratch folder.
    """
    edges = land(edges, "edges")
    left, taken = edges.select("lo", "hi"), None
    while not left.isEmpty():
        roots = left.select("lo").distinct().join(left.select(F.col("hi").alias("lo")), "lo", "left_anti")
        took = land(left.join(roots, "lo").select("hi").distinct(), "taken")
        taken = took if taken is None else taken.union(took)
        gone = roots.union(took)
        left = land(left.join(gone, "lo", "left_anti").join(gone.withColumnRenamed("lo", "hi"), "hi", "left_anti"), "edges")
    nodes = edges.select(F.col("lo").alias("id")).union(edges.select("hi")).distinct()
    if taken is None:
        return nodes.withColumn("seed", F.col("id"))
    beside = edges.join(taken.select("hi"), "hi").join(taken.select(F.col("hi").alias("lo")), "lo", "left_anti")
    seed = beside.groupBy(F.col("hi").alias("id")).agg(F.min_by("lo", F.struct("lo_t", "lo")).alias("seed"))
    return nodes.join(seed, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def signed(rows: DataFrame, guard: bool = True) -> DataFrame:
    """rows with what may_merge looks at in a title: denies, versions and names (identifiers)."""
    if not guard:
        return rows.withColumns({"denies": F.lit(False), "versions": F.lit(""), "names": F.array().cast("array<string>")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = pdf["title"]
            yield pdf.assign(denies=t.map(denies), versions=t.map(lambda x: " ".join(sorted(set(_VERSION.findall(x))))), names=t.map(lambda x: sorted(identifiers(x))))

    return rows.mapInPandas(run, rows.withColumns({"denies": F.lit(True), "versions": F.lit(""), "names": F.array(F.lit(""))}).schema)


def greedy_groups(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, seed_id) of rows (id, total, kind, denies, versions, names), where members of a kind are alike, and those of kinds that edges (a, b) join: in order of
    total and id, a record joins the first seed beside it that it may merge with, else becomes a seed.

    Members of a kind of equal denial, versions and identifiers fare alike, so they are one node; nodes meet by a shared identifier, or where one has none.
    """
    sign = ("kind", "denies", "versions", "names")
    nodes = rows.groupBy(*sign).agg(F.min(F.struct((-F.col("total")).alias("t"), "id")).alias("f"))
    nodes = land(nodes.select(*sign, F.col("f.id").alias("node"), F.col("f.t").alias("t")), "nodes")
    alike = edges.select("a", "b").union(edges.select("b", "a")).union(nodes.groupBy("kind").count().where("count > 1").select("kind", "kind"))
    x, y = (nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in nodes.columns)) for s in "xy")
    left = x.join(alike, F.col("kind_x") == F.col("a"))
    # a class has few nodes without identifiers: they meet all others; the rest meets by an identifier
    none = left.where(F.size("names_x") == 0).join(y, F.col("b") == F.col("kind_y"))
    named = left.withColumn("name", F.explode("names_x")).join(y.withColumn("name_y", F.explode("names_y")), (F.col("b") == F.col("kind_y")) & (F.col("name") == F.col("name_y")))
    both = none.drop("a", "b").union(named.drop("a", "b", "name", "name_y")).where("denies_x = denies_y and (versions_x = versions_y or versions_x = '' or versions_y = '')")
    x_first = F.struct("t_x", "node_x") < F.struct(F.col("t_y").alias("t_x"), F.col("node_y").alias("node_x"))
    pick = lambda c: F.when(x_first, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y"))
    late = F.when(x_first, F.col("node_y")).otherwise(F.col("node_x"))
    seeds = first_seeds(both.where("node_x <> node_y").select(pick("node").alias("lo"), pick("t").alias("lo_t"), late.alias("hi")).distinct())
    seeds = nodes.join(seeds.withColumnRenamed("id", "node"), "node", "left").select(*sign, F.coalesce("seed", "node").alias("seed_id"))
    return rows.join(seeds, list(sign)).select("id", "seed_id")


def title_groups(records: DataFrame, least: float = 0.5, scope: tuple[str, ...] = ("project_id", "branch"), guard: bool = True) -> DataFrame:
    """(id, seed_id) of greedy groups within each scope: in order of total and id, a record joins the first seed that its
    title is similar to and may merge with, else becomes a seed. Only records that have a similar one at all take part.

    Titles of equal words, versions and identifiers fare alike, so they are one node; nodes meet by similar classes of words and a
    shared identifier, or where one has none, and first_seeds decides in rounds. No scope is one task.
    """
    edges = title_pairs(records, least, scope)
    kinds = title_classes(records, scope)
    busy = kinds.where("members > 1").select("kind").union(edges.select("a")).union(edges.select("b")).distinct()
    toks = F.array_sort(T.significant_tokens(F.col("title")))
    on = F.col("r.toks") == F.col("k.toks")
    for c in scope:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    total = (F.col("from_auto") + F.col("from_search") + F.col("from_drill")).alias("total")
    rows = records.withColumn("toks", toks).alias("r").join(kinds.join(busy, "kind").alias("k"), on).select("r.id", "r.title", total, "k.kind")
    return greedy_groups(land(signed(rows, guard).drop("title"), "titles"), edges)


def merge_guard(pairs: DataFrame, a: str = "title_a", b: str = "title_b") -> DataFrame:
    """pairs with may_merge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(may_merge=[may_merge(x or "", y or "") for x, y in zip(pdf[a], pdf[b], strict=True)])

    return pairs.mapInPandas(run, pairs.withColumn("may_merge", F.lit(True)).schema)


def audit_records(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """lines (line_id, doc_ids, ...) with ids: the records whose chunks a line's hits are, by observation_id in the metadata (JSON) of chunks
    (chunk_id, metadata). Hits of other chunks, and ids that aren't whole numbers above 0, are left out; a line may come to have none."""
    number = F.get_json_object("metadata", "$.observation_id")
    of = chunks.where(number.rlike("^[0-9]{1,18}$")).select(F.col("chunk_id").alias("doc_id"), number.cast("long").alias("record_id")).where("record_id > 0").dropDuplicates(["doc_id"])
    hits = lines.select("line_id", F.posexplode("doc_ids").alias("n", "doc_id")).join(of, "doc_id")
    found = hits.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("n", "record_id"))).alias("r"))
    return lines.join(found, "line_id", "left").withColumn("ids", F.coalesce(F.transform("r", lambda x: x["record_id"]), F.array().cast("array<long>"))).drop("r")


def co_retrieval(lines: DataFrame) -> DataFrame:
    """(a, b, together), a < b: in how many lines (line_id, ids) two ids are together. Lines are short: what one prompt was given."""
    one = lines.select("line_id", F.explode(F.array_distinct("ids")).alias("id"))
    a, b = one.select("line_id", F.col("id").alias("a")), one.select("line_id", F.col("id").alias("b"))
    return a.join(b, "line_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))


def co_similarity(together: Column, a: Column, b: Column) -> Column:
    union = a + b - together
    return F.when(union <= 0, 0.0).otherwise(F.least(F.lit(1.0), together.cast("double") / union))


def time_similarity(a: Column, b: Column, tau_days: float = 7.0) -> Column:
    return F.exp(-F.abs((a - b).cast("double")) / F.lit(tau_days * 86400))


def blended(co: Column, time: Column, semantic: Column | None = None) -> Column:
    """.5 co-retrieval, .3 time and .2 meaning; without meaning the other two share its weight."""
    if semantic is None:
        return F.lit(0.625) * co + F.lit(0.375) * time
    known = F.lit(0.2) * semantic + F.lit(0.3) * time + F.lit(0.5) * co
    return F.when(semantic.isNull(), F.lit(0.625) * co + F.lit(0.375) * time).otherwise(known)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b): the smallest id that can be reached; as many rounds as it takes, written to the scratch folder."""
    edges = land(edges.select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return nodes.join(connected_components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dbscan(points: DataFrame, distances: DataFrame, eps: float = 0.35, least: int = 3) -> DataFrame:
    """(id, cluster, is_core) of points (id) with distances (a, b, distance), a < b: cluster is its least core id, null for noise.

    A point counts among its own neighbours. Cores within eps are one cluster; a border point goes to the least one beside it.
    """
    near = distances.where(F.col("distance") <= eps).select("a", "b")
    both = near.union(near.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("n"))
    core = points.select("id").join(degree, "id", "left").where(F.coalesce("n", F.lit(1)) >= least).select("id")
    inner = near.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    label = core.join(components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("cluster").alias("beside"))
    out = points.select("id").join(label, "id", "left").join(border, F.col("id") == F.col("a"), "left")
    return out.select("id", F.coalesce("cluster", "beside").alias("cluster"), F.col("cluster").isNotNull().alias("is_core"))
