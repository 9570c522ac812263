"""Whole passes over the corpus, composed of the other operators: dedup, supersession, promotion, use, and search by channel."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lifecycle as L
from quarry.operators import records as R
from quarry.operators import search as H
from quarry.operators import semantic as G
from quarry.operators import similarity as M
from quarry.operators.scratch import land


def dedup_merges(records: DataFrame, vectors: DataFrame, titles: float = 0.5, least: float = 0.95) -> DataFrame:
    """(survivor_id, id): members of title groups whose vectors confirm them; drilled and anchored members and those without a vector stay."""
    live = records.where(~F.col("archived"))
    groups = M.title_groups(live, titles).where("id <> seed_id")
    free = live.where((F.col("from_drill") == 0) & ~F.col("is_anchored")).select("id")
    pairs = groups.join(free, "id", "left_semi").select(F.col("seed_id").alias("a"), F.col("id").alias("b"))
    return G.confirmed(pairs, vectors, least).select(F.col("a").alias("survivor_id"), F.col("b").alias("id"))


def supersessions(records: DataFrame, vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(id, superseded_by): older versions whose vector confirms that the head is about the same."""
    pairs = R.supersede_candidates(records).select(F.col("id").alias("a"), F.col("head_id").alias("b"))
    return G.confirmed(pairs, vectors, least).select(F.col("a").alias("id"), F.col("b").alias("superseded_by"))


def collapsed(records: DataFrame, titles: float = 0.5) -> DataFrame:
    """For display: one row for each title group, with summed counters, the latest surfacing and the number of variants."""
    groups = M.title_groups(records, titles, guard=False)
    j = records.join(groups, "id", "left").withColumn("seed_id", F.coalesce("seed_id", "id"))
    counters = ("from_auto", "from_search", "from_drill")
    g = j.groupBy("seed_id").agg(*(F.sum(c).alias(c) for c in counters), F.max("last_surfaced").alias("last_surfaced"), F.count("*").alias("variants"))
    titles_ = records.select(F.col("id").alias("seed_id"), "title", "type")
    return g.join(titles_, "seed_id").withColumn("total", F.col("from_auto") + F.col("from_search") + F.col("from_drill")).withColumnRenamed("seed_id", "id")


def dream_report(points: DataFrame, distances: DataFrame, created: DataFrame, together: DataFrame, eps: float = 0.35, least: int = 3) -> DataFrame:
    """A row for each cluster of use, and one without a cluster for noise: members, cores, first and last creation, span_days, co_weight (how often pairs of its members
    were given together; together is (a, b, together) of co-retrieval), and of all points total and without_co, those that were never given together with another."""
    c = M.dbscan(points, distances, eps, least).join(created, "id", "left")
    x, y = (c.select(F.col("id").alias(s), F.col("cluster").alias(f"c{s}")) for s in "ab")
    weight = together.join(x, "a").join(y, "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("together").alias("co_weight"))
    met = together.select(F.col("a").alias("id")).union(together.select("b")).distinct()
    alone = points.select("id").join(met, "id", "left_anti").agg(F.count("*").alias("without_co"))
    days = ((F.max("created") - F.min("created")) / 86400).alias("span_days")
    report = c.groupBy("cluster").agg(F.count("*").alias("members"), F.count(F.when(F.col("is_core"), 1)).alias("cores"), F.min("created").alias("first"), F.max("created").alias("last"), days)
    whole = points.agg(F.count("*").alias("total")).crossJoin(alone)
    return report.join(weight, "cluster", "left").withColumn("co_weight", F.coalesce("co_weight", F.lit(0)).cast("long")).crossJoin(F.broadcast(whole))


#: fixed value: rows that are looked at for groups at least, before a page is cut
CANDIDATES = 200


def collapsed_page(records: DataFrame, sort: str = "total", view: str = "all", kind: str | None = None, title: str | None = None, offset: int = 0, limit: int = 50, titles: float = 0.5) -> tuple[DataFrame, int]:
    """One page of the recall browser with near titles put together, and how many rows matched before that.

    The first rows by `sort` (total, recency, from_auto, from_search or from_drill), as many as the page reaches and CANDIDATES at least, are grouped in that
    order by title; a group is a row with summed counters, the latest surfacing and its number of variants. Groups are put in order anew, ties by
    the latest surfacing and the larger id, and the page is cut from them.
    """
    rows = R.viewed(records, view, kind, title)
    metric = F.coalesce("last_surfaced", F.lit(0)) if sort == "recency" else F.col(sort)
    order = (metric.desc(), F.coalesce("last_surfaced", F.lit(0)).desc(), F.desc("id"))
    first = rows.orderBy(*order).limit(max(CANDIDATES, offset + limit))
    # the groups are greedy by total and id: here the place in the order takes the total's part
    placed = land(first.withColumn("place", F.row_number().over(Window.orderBy(*order))), "candidates")
    by_place = placed.select("id", "title", (-F.col("place")).alias("from_auto"), F.lit(0).alias("from_search"), F.lit(0).alias("from_drill"))
    groups = M.title_groups(by_place, titles, (), False)
    j = placed.join(groups, "id", "left").withColumn("seed_id", F.coalesce("seed_id", "id"))
    sums = (F.sum(c).alias(c) for c in ("from_auto", "from_search", "from_drill", "total"))
    g = j.groupBy("seed_id").agg(*sums, F.max("last_surfaced").alias("last_surfaced"), F.count("*").alias("variants"))
    shown = g.join(placed.select(F.col("id").alias("seed_id"), "title", "type"), "seed_id").withColumnRenamed("seed_id", "id")
    return shown.orderBy(*order).offset(offset).limit(limit), rows.count()


def promotions(records: DataFrame, keep: Callable[[DataFrame], DataFrame], now: int, most: int = 5) -> DataFrame:
    """The first `most` candidates that the judge `keep` (a filter of candidates) lets through, with the time of promotion."""
    return keep(R.promotion_candidates(records, limit=most)).withColumn("promoted_at", F.lit(now).cast("long"))


def use_report(points: DataFrame, distances: DataFrame, created: DataFrame, eps: float = 0.35, least: int = 3) -> DataFrame:
    """Clusters of use with their size and span in days; noise is the row without a cluster."""
    c = M.dbscan(points, distances, eps, least).join(created, "id", "left")
    days = ((F.max("created") - F.min("created")) / 86400).alias("span_days")
    return c.groupBy("cluster").agg(F.count("*").alias("members"), F.count(F.when(F.col("is_core"), 1)).alias("cores"), days)


def touching(files: Column, asked: list[str]) -> Column:
    """Whether one of the asked files is among files: a condition for search_channel and for records."""
    return F.coalesce(F.arrays_overlap(files, F.array(*map(F.lit, asked)).cast("array<string>")), F.lit(False))


def search_channel(docs: DataFrame, vectors: DataFrame, queries: DataFrame, channel: str, k: int = 5, prefilter: bool = False, p: H.RankProfile = H.RankProfile(), where: Column | None = None) -> DataFrame:
    """Hits of one channel for which `where`, a condition on columns of docs (type, skill, files), is true. As a rule both are
    filtered after fusion, so a small channel can come up short; prefilter looks among these documents alone."""
    fits = F.col("channel") == channel if where is None else (F.col("channel") == channel) & where
    if prefilter:
        docs = docs.where(fits)
        vectors = vectors.join(docs.select("id"), "id", "left_semi")
    found = H.hybrid(docs, vectors, queries, 2 * p.per_leg, p).join(docs.where(fits).select("id", "channel"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def tides(records: DataFrame, now: int) -> DataFrame:
    """(id, multiplier) of records: how much their hits count for by buoyancy."""
    b = L.buoyancy(F.col("stability_days"), F.col("last_surfaced"), F.col("created"), F.col("is_anchored"), now)
    return records.select("id", L.multiplier(b).alias("multiplier"))


def injected(docs: DataFrame, vectors: DataFrame, queries: DataFrame, records: DataFrame, now: int, k: int = 5, p: H.RankProfile = H.RankProfile()) -> DataFrame:
    """What prompts are given: three times k hits, weighed by the buoyancy of their records, those of archived and sunk records dropped, superseded ones demoted, cut to k, and aged."""
    afloat = tides(records, now).join(docs.where(F.col("channel") == "observation").select("id"), "id", "left_semi")
    hits = H.hybrid(docs, vectors, queries, 3 * k, p, afloat)
    gone = records.where(F.col("archived") | (F.col("tide_state") != "active")).select("id")
    hits = H.without(hits, gone).join(records.select("id", "superseded", "created"), "id", "left")
    hits = hits.join(docs.select("id", "channel"), "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    top = H.demoted(hits, p).where(F.col("rank") <= k)
    return H.temporal_rerank(top, now, p)


def by_profile(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Results of both rank profiles, for evaluation side by side. Both rank the same hits of the legs, which are searched for once."""
    profiles = {"legacy": H.LEGACY, "v2": H.RankProfile()}
    most = max(p.per_leg for p in profiles.values())
    legs = [land(H.knn(vectors, queries, most), "vector"), land(H.bm25(docs, queries, most), "keyword")]
    one = lambda name, p: H.hybrid(docs, vectors, queries, k, p, legs=[leg.where(F.col("rank") <= p.per_leg) for leg in legs]).withColumn("profile", F.lit(name))
    legacy, v2 = (one(*x) for x in profiles.items())
    return legacy.unionByName(v2)


def bumps(hits: DataFrame, source: str, ts: int) -> DataFrame:
    """Surfacing events of hits, to be appended to the log that records.bumped folds."""
    return hits.select("id").distinct().select("id", F.lit(ts).cast("long").alias("ts"), F.col("id").alias("seq"), F.lit(source).alias("src"))
