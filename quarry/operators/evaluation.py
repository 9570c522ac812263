"""Ranking quality over many queries at once: results (profile, query_id, rank, id) with grades."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.search import in_blocks


def mrr(ranked: DataFrame, relevant: int = 2) -> DataFrame:
    """Mean over queries of 1 / rank of the first result graded relevant (0 without one)."""
    per = ranked.groupBy("profile", "query_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("grade") >= relevant, F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.groupBy("profile").agg(F.avg("rr").alias("mrr"))


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Mean nDCG at k; the ideal order is of the grades retrieved."""
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1.0)
    best = F.row_number().over(Window.partitionBy("profile", "query_id").orderBy(F.desc("grade"), "rank"))
    r = ranked.withColumn("best", best)
    per = r.groupBy("profile", "query_id").agg(F.sum(F.when(F.col("rank") <= k, gain("rank"))).alias("dcg"), F.sum(F.when(F.col("best") <= k, gain("best"))).alias("idcg"))
    return per.groupBy("profile").agg(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"))


def recall(ranked: DataFrame, k: int = 10, relevant: int = 2) -> DataFrame:
    good = F.col("grade") >= relevant
    per = ranked.groupBy("profile", "query_id").agg(F.count(F.when(good & (F.col("rank") <= k), 1)).alias("hit"), F.count(F.when(good, 1)).alias("all"))
    return per.groupBy("profile").agg(F.avg(F.when(F.col("all") > 0, F.col("hit") / F.col("all")).otherwise(0.0)).alias("recall"))


def freshness(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Whether the first result is a query's freshest, and the share of stale ones within k. ranked has created; ties go to the lower id."""
    w = Window.partitionBy("profile", "query_id").orderBy(F.desc("created"), "id")
    r = ranked.withColumn("fresh", F.row_number().over(w) == 1).where(F.col("rank") <= k)
    per = r.groupBy("profile", "query_id").agg(F.max(((F.col("rank") == 1) & F.col("fresh")).cast("int")).alias("first"), F.avg((~F.col("fresh")).cast("double")).alias("stale"))
    return per.groupBy("profile").agg(F.avg("first").alias("freshness"), F.avg("stale").alias("staleness"))


def seeded_queries(audit: DataFrame, limit: int) -> DataFrame:
    """The most asked queries of an audit log."""
    return audit.where("query is not null").groupBy("query").agg(F.count("*").alias("asked")).orderBy(F.desc("asked"), "query").limit(limit)


def displaced(turns: DataFrame, injections: DataFrame, within_ms: int = 20_000) -> DataFrame:
    """turns (session_id, turn_id, ts) with the last injection (ts) at most within_ms away, in its session.

    Time is cut in bins of that length, and a turn meets its own bin and the two beside it: an equi-join.
    """
    t = turns.withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("ts") / within_ms) + d)))
    i = injections.select("session_id", F.col("ts").alias("injected_ts"), F.floor(F.col("ts") / within_ms).alias("bin"))
    near = t.join(i, ["session_id", "bin"]).where(F.abs(F.col("ts") - F.col("injected_ts")) <= within_ms)
    best = near.groupBy("session_id", "turn_id").agg(F.max("injected_ts").alias("injected_ts"))
    return turns.join(best, ["session_id", "turn_id"], "left")


def entity_staleness(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, id, stale) of docs (id, text, created) that contain an entity in any case: the freshest is not stale, ties to the lower id. Entities meet all docs
    in blocks of a bounded number."""
    hit = None
    for block in in_blocks(entities.select("entity"), "entity"):
        part = docs.crossJoin(F.broadcast(block)).where(F.contains(F.lower("text"), F.lower("entity")))
        hit = part if hit is None else hit.union(part)
    w = Window.partitionBy("entity").orderBy(F.desc("created"), "id")
    return hit.select("entity", "id", (F.row_number().over(w) > 1).alias("stale"))


def displacement(turns: DataFrame) -> DataFrame:
    """Turns, mean and median discovery calls with and without an injection (turns has injected_ts and calls)."""
    return turns.groupBy(F.col("injected_ts").isNotNull().alias("injected")).agg(F.count("*").alias("turns"), F.avg("calls").alias("mean"), F.percentile("calls", 0.5).alias("median"))


def report(results: DataFrame, golden: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """A row for each profile: mrr, ndcg5, ndcg10 and recall10 over queries of other classes than temporal, by the judge's grades; freshness and staleness over temporal
    queries with an entity; n and n_temporal.

    results: profile, query_id, rank, id, text, created. golden: query_id, class, entity. grades: query_id, id, grade. Only the first k results count. A query without results, or a
    temporal one of whose results none holds its entity (in any case), counts as 0. Of equally fresh results the first is the freshest.
    """
    top = results.where(F.col("rank") <= k)
    temporal = F.coalesce((F.col("class") == "temporal") & (F.length("entity") > 0), F.lit(False))
    asked = results.select("profile").distinct().crossJoin(golden.select("query_id", "class", "entity").withColumn("temporal", temporal))
    plain = asked.where(~F.col("temporal") & (F.coalesce("class", F.lit("")) != "temporal")).select("profile", "query_id")
    ranked = plain.join(top.select("profile", "query_id", "rank", "id"), ["profile", "query_id"], "left").join(grades.select("query_id", "id", "grade"), ["query_id", "id"], "left")
    ranked = ranked.withColumn("grade", F.coalesce("grade", F.lit(0)))
    hits = asked.where("temporal").join(top, ["profile", "query_id"], "left").withColumn("holds", F.coalesce(F.contains(F.lower("text"), F.lower("entity")), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("profile", "query_id").orderBy(F.desc("holds"), F.desc("created"), "rank")) == 1
    hits = hits.withColumn("fresh", F.col("holds") & first)
    at_one = F.max(((F.col("rank") == 1) & F.col("fresh")).cast("int"))
    stale = F.count(F.when(F.col("holds") & ~F.col("fresh"), 1)) / F.greatest(F.count("rank"), F.lit(1))
    per = hits.groupBy("profile", "query_id").agg(F.coalesce(at_one, F.lit(0)).alias("first"), stale.alias("stale"))
    fresh = per.groupBy("profile").agg(F.avg("first").alias("freshness"), F.avg("stale").alias("staleness"))
    out = asked.groupBy("profile").agg(F.count("*").alias("n"), F.count(F.when(F.col("temporal"), 1)).alias("n_temporal"))
    parts = (mrr(ranked), ndcg(ranked, 5).withColumnRenamed("ndcg", "ndcg5"), ndcg(ranked, 10).withColumnRenamed("ndcg", "ndcg10"), recall(ranked, k).withColumnRenamed("recall", "recall10"), fresh)
    for part in parts:
        out = out.join(part, "profile", "left")
    return out.na.fill(0.0, ["mrr", "ndcg5", "ndcg10", "recall10", "freshness", "staleness"])
