"""Hybrid retrieval: keyword and vector legs for a batch of queries, fusion, and re-ranking.

Queries are a DataFrame too (query_id, query, and vector for the vector leg), so one plan answers all.
A leg is (query_id, id, rank, score).
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.functions.lifecycle import recency
from quarry.operators import nearest as N
from quarry.operators.scratch import land


@dataclass(frozen=True)
class RankProfile:
    fusion: str = "weighted"
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_k: int = 60
    per_leg: int = 25
    temporal: bool = True
    half_life_days: float = 21.0
    temporal_top: int = 10
    temporal_floor: float = 0.5
    rare_weight: float = 1.15
    superseded_weight: float = 0.5
    identifier_step: float = 0.3
    identifier_cap: float = 2.0
    branch_weight: float = 1.1


LEGACY = RankProfile(fusion="rrf", temporal=False, rare_weight=1.0, superseded_weight=1.0)
K1, B = 1.2, 0.75


#: rows that go to every task at most; more take turns
BLOCK = 2000


def in_blocks(df: DataFrame, key: str, most: int = BLOCK) -> list[DataFrame]:
    """df in parts of about `most` rows, so that each may be broadcast."""
    parts = -(-df.count() // most)
    return [df] if parts <= 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


#: terms that go to every task at most; more meet the postings by a shuffle
TERMS = 100_000


def small(df: DataFrame, most: int = TERMS) -> bool:
    """Whether df has at most `most` rows, so that it may be broadcast."""
    return df.limit(most + 1).count() <= most


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query. Spark keeps k of each task and query before it shuffles (window group limit)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of docs (id, text): the inverted index."""
    terms = docs.select("id", T.tokens("text").alias("terms")).withColumn("dl", F.size("terms"))
    return terms.select("id", "dl", F.explode("terms").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: n documents and their mean length in tokens."""
    return docs.select(F.size(T.tokens("text")).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """Okapi BM25 (k1 1.2, b 0.75) of distinct query terms, idf floored at 1e-6; ties by id.

    Only postings of the queries' terms are kept: a set of up to TERMS goes to every task, so that other terms aren't shuffled; a larger one is joined by a shuffle.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.tokens("query"))).alias("term"))
    terms = docs.select("id", T.tokens("text").alias("terms")).select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    asked = wanted.select("term").distinct()
    sent = F.broadcast if small(asked) else (lambda x: x)
    post = terms.join(sent(asked), "term").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    scored = post.join(sent(df), "term").join(wanted, "term").crossJoin(F.broadcast(corpus_size(docs)))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    total = scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return _top(total, k, F.round("score", 9).desc(), F.col("id")).select("query_id", "id", "rank", "score")


def _nearest(asked: Broadcast, k: int, cosine: bool):
    """Each task's k nearest of each query, ties by id, so that only these are shuffled. Distances are L2, or cosines with their sign turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = N.Nearest(*asked.value, k, cosine)
        for batch in batches:
            for rows, x in N.by_length(batch["vector"]):
                near.add(x, batch["id"].take(pa.array(rows)))
        yield from near.batches()

    return run


def _far(vectors: DataFrame, queries: DataFrame, k: int, cosine: bool) -> DataFrame:
    """(query_id, id, distance) of candidates that hold each query's k nearest; queries meet all vectors in blocks that go to every task."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    rows = vectors.select("id", "vector")
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, distance double"
    far = None
    for block in in_blocks(queries.where("vector is not null").select("query_id", "vector"), "query_id"):
        got = block.toArrow()  # as many rows as a block has
        asked = got["query_id"].combine_chunks(), [np.array(v, np.float64) for v in got["vector"].to_pylist()]
        pairs = rows.mapInArrow(_nearest(vectors.sparkSession.sparkContext.broadcast(asked), k, cosine), schema)
        far = pairs if far is None else far.unionByName(pairs)
    return far


def knn(vectors: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """Exact nearest vectors by L2; score is the cosine moved to 0..1. Queries meet all vectors in blocks that go to every task.
    Null vectors, those of another length and those with null or non-finite parts are near nothing."""
    top = _top(_far(vectors, queries, k, False), k, F.round("distance", 9), F.col("id"))
    return top.select("query_id", "id", "rank", "distance", V.similarity_of_distance(F.col("distance")).alias("score"))


def knn_cosine(vectors: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, id, rank, cosine): the vectors of largest cosine, ties by id; a zero vector has cosine 0 with all. Else as knn."""
    top = _top(_far(vectors, queries, k, True), k, F.round("distance", 9), F.col("id"))
    return top.select("query_id", "id", "rank", (-F.col("distance")).alias("cosine"))


def isolated(legs: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """The legs' results in order, and why those failed that did: a leg that throws, while it is put together or while it runs, is an empty one, and the
    search goes on with the others. Results are written once, so what fails fails here."""
    found: dict[str, DataFrame] = {}
    why: dict[str, str] = {}
    for name, leg in legs.items():
        try:
            found[name] = land(leg(), name)
        except Exception as e:  # noqa: BLE001  whatever a leg's source throws
            why[name] = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
    if not found:
        raise RuntimeError(f"all legs failed: {why}")
    shape = next(iter(found.values())).select("query_id", "id", "rank", "score").limit(0)
    return [found.get(name, shape) for name in legs], why


def rrf(legs: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, over the best that all legs together could give; ties by first leg and rank in it."""
    ranked = None
    for i, leg in enumerate(legs):
        one = leg.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("leg"), F.col("rank")).alias("first"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = len(legs) / (k + 1)
    return ranked.groupBy("query_id", "id").agg((F.sum("part") / F.lit(best)).alias("score"), F.min("first").alias("first"))


def weighted(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Weighted fusion. Keyword scores are min-max normalised per query (all alike: 1); what one leg alone found keeps its whole score."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    kw = keyword.select("query_id", "id", norm.alias("kw"), F.col("rank").alias("kr"))
    both = vector.select("query_id", "id", F.col("score").alias("sem"), F.col("rank").alias("vr")).join(kw, ["query_id", "id"], "full_outer")
    score = F.when(F.col("kw").isNull(), F.col("sem")).when(F.col("sem").isNull(), F.col("kw")).otherwise(F.lit(vector_weight) * F.col("sem") + F.lit(keyword_weight) * F.col("kw"))
    first = F.when(F.col("vr").isNotNull(), F.struct(F.lit(0).alias("leg"), F.col("vr").alias("rank"))).otherwise(F.struct(F.lit(1).alias("leg"), F.col("kr").alias("rank")))
    return both.select("query_id", "id", score.alias("score"), first.alias("first"))


def reranked(hits: DataFrame) -> DataFrame:
    """hits with rank anew: by score, ties by first leg and rank in it."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("first.leg"), F.col("first.rank"), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w))


def identifiers(query: Column) -> Column:
    """Words of a query that look like code: with _ . or /, or a capital inside."""
    words = F.transform(F.split(query, r"\s+"), lambda t: F.regexp_replace(t, r"""[,;:!?)\]}'"]+$""", ""))
    return F.filter(words, lambda t: (F.length(t) > 0) & t.rlike("[_./]|[a-z][a-zA-Z]*[A-Z]"))


def rare_words(query: Column) -> Column:
    words = F.transform(F.split(query, r"\s+"), lambda t: F.regexp_replace(t, r"""[,;:!?)\]}'"]+$""", ""))
    fine = lambda t: (F.length(t) >= 4) & t.rlike(r"^[\p{L}\p{N}_]+$") & ~F.lower(t).isin(*T.QUERY_STOPWORDS) & ~t.rlike("[_./]|[a-z][a-zA-Z]*[A-Z]")
    return F.array_distinct(F.filter(words, fine))


def identifier_boost(query: Column, text: Column, p: RankProfile = RankProfile()) -> Column:
    n = F.size(F.filter(identifiers(query), lambda t: F.contains(text, t)))
    return F.least(1.0 + F.lit(p.identifier_step) * n, F.lit(p.identifier_cap))


def rare_boost(query: Column, text: Column, p: RankProfile = RankProfile()) -> Column:
    return F.when(F.exists(rare_words(query), lambda t: F.contains(text, t)), p.rare_weight).otherwise(1.0)


def boosted(hits: DataFrame, p: RankProfile = RankProfile()) -> DataFrame:
    """hits (query, text, and branch and current_branch, if given) with boosts in the score."""
    score = F.col("score") * identifier_boost(F.col("query"), F.col("text"), p) * rare_boost(F.col("query"), F.col("text"), p)
    if "branch" in hits.columns:
        score = score * F.when(F.col("branch") == F.col("current_branch"), p.branch_weight).otherwise(1.0)
    return hits.withColumn("score", score)


def temporal_rerank(hits: DataFrame, now: int, p: RankProfile = RankProfile()) -> DataFrame:
    """Among the first of each query by rank, observations lose by age (not below the floor) and are put in order anew; the rest stays."""
    head = F.col("rank") <= p.temporal_top
    factor = F.when(F.col("channel") == "observation", recency(F.lit(now) - F.col("created"), p.half_life_days, p.temporal_floor)).otherwise(1.0)
    w = Window.partitionBy("query_id").orderBy((~head).cast("int"), F.when(head, -F.round("score", 9)), F.col("rank"))
    return hits.withColumn("score", F.when(head, F.col("score") * factor).otherwise(F.col("score"))).withColumn("rank", F.row_number().over(w))


def demoted(hits: DataFrame, p: RankProfile = RankProfile()) -> DataFrame:
    """Superseded hits lose, and all are put in order anew."""
    score = F.when(F.col("superseded"), F.col("score") * F.lit(p.superseded_weight)).otherwise(F.col("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("rank"))
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def without(hits: DataFrame, dropped: DataFrame, key: str = "id") -> DataFrame:
    """hits whose key isn't in dropped; hits without a key stay."""
    return hits.join(dropped.select(key).distinct(), key, "left_anti")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, p: RankProfile = RankProfile(), tide: DataFrame | None = None, legs: list[DataFrame] | None = None) -> DataFrame:
    """Both legs, fused, boosted by words of the query, and cut to k: (query_id, id, rank, score).

    If docs have a branch and queries a current_branch, hits of that branch gain. tide (id, multiplier, one row an id) scales
    the hits that it names before the cut. legs are the vector and the keyword leg, if they come from elsewhere: from kept indexes, or through isolated().
    """
    legs = legs or [knn(vectors, queries, p.per_leg), bm25(docs, queries, p.per_leg)]
    fused = weighted(*legs, p.vector_weight, p.keyword_weight) if p.fusion == "weighted" else rrf(list(legs), p.rrf_k)
    branches = "branch" in docs.columns and "current_branch" in queries.columns
    of_docs, of_queries = (["branch"], ["current_branch"]) if branches else ([], [])
    # texts are looked at only for words of a query: without any, a hit needs none
    wants = F.coalesce((F.size(identifiers(F.col("query"))) > 0) | (F.size(rare_words(F.col("query"))) > 0), F.lit(True))
    found = land(fused.join(queries.select("query_id", "query", wants.alias("wants"), *of_queries), "query_id"), "fused")
    asked = found.where("wants").select("id").distinct()
    texts = docs.select("id", "text").join(F.broadcast(asked) if small(asked) else asked, "id", "left_semi")
    found = found.where("wants").join(texts, "id", "left").unionByName(found.where("not wants").withColumn("text", F.lit("")))
    if branches:
        found = found.join(docs.select("id", *of_docs), "id", "left")
    found = boosted(found.withColumn("text", F.coalesce("text", F.lit(""))), p)
    if tide is not None:
        found = found.join(tide.select("id", "multiplier"), "id", "left").withColumn("score", F.col("score") * F.coalesce("multiplier", F.lit(1.0)))
    return reranked(found).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")
