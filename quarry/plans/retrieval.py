"""Queries over search, the vector index, evaluation, texts and transcripts, each with its SQL."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.functions.lifecycle import recency
from quarry.operators import evaluation as E
from quarry.operators import index as I
from quarry.operators import search as H
from quarry.plans import tables as X
from quarry.plans.core import ALL, BUOY, NOW, query, r6
from quarry.sources import chunkers, transcripts

BM25 = r"""t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM q),
p AS (SELECT term, id, len(toks) AS dl, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM t) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT query_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM w JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
kw AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM b QUALIFY rank <= 25)"""
KNN = """d AS (SELECT query_id, vec_id AS id, list_distance(embedding::DOUBLE[], qv::DOUBLE[]) AS distance FROM embeddings, q),
vec AS (SELECT query_id, id, distance, greatest(0.0, least(1.0, 1 - distance * distance / 4)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d QUALIFY rank <= 25)"""
WEIGHTED = """kn AS (SELECT *, CASE WHEN max(score) OVER v = min(score) OVER v THEN 1.0 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END AS k FROM kw WINDOW v AS (PARTITION BY query_id)),
fused AS (SELECT coalesce(vec.query_id, kn.query_id) AS query_id, coalesce(vec.id, kn.id) AS id, CASE WHEN k IS NULL THEN vec.score WHEN vec.score IS NULL THEN k ELSE 0.7 * vec.score + 0.3 * k END AS score,
  CASE WHEN vec.rank IS NULL THEN 1 ELSE 0 END AS leg, coalesce(vec.rank, kn.rank) AS lr FROM vec FULL JOIN kn ON vec.query_id = kn.query_id AND vec.id = kn.id)"""
LEGS = f"{X.ASKED_TWICE}, {BM25}, {KNN}"
RARE = """x AS (SELECT query_id, query, list_filter(list_distinct(list_transform(string_split_regex(query, '\\s+'), lambda z: regexp_replace(z, '[,;:!?)\\]}''"]+$', ''))), lambda z: len(z) >= 4 AND regexp_matches(z, '^[\\p{L}\\p{N}]+$') AND lower(z) NOT IN ('with', 'what', 'which', 'this', 'that', 'from', 'your', 'about', 'does', 'when', 'where', 'into', 'over', 'than', 'then', 'they', 'them', 'version', 'latest', 'current', 'release')) AS rare,
  list_filter(list_transform(string_split_regex(query, '\\s+'), lambda z: regexp_replace(z, '[,;:!?)\\]}''"]+$', '')), lambda z: len(z) > 0 AND regexp_matches(z, '[_./]|[a-z][a-zA-Z]*[A-Z]')) AS ident FROM q)"""
BOOSTS = "least(2.0, 1.0 + 0.3 * len(list_filter(ident, lambda z: contains(coalesce(text, ''), z)))) * CASE WHEN len(list_filter(rare, lambda z: contains(coalesce(text, ''), z))) > 0 THEN 1.15 ELSE 1.0 END"


def _legs(spark, d):
    q = X.asked_twice(spark, d)
    return H.knn(X.vectors(spark, d), q), H.bm25(X.chunks(spark, d), q)


@query(f"WITH {X.ASKED}, {BM25} SELECT query_id, id, rank, round(score, 6) AS score FROM kw")
def bm25_topk(spark, d):
    return H.bm25(X.chunks(spark, d), X.asked(spark, d)).withColumn("score", r6(F.col("score")))


@query(f"WITH {X.ASKED_TWICE}, {KNN} SELECT query_id, id, rank, round(distance, 6) AS distance, round(score, 6) AS score FROM vec")
def knn_l2_topk(spark, d):
    return H.knn(X.vectors(spark, d), X.asked_twice(spark, d)).withColumns({"distance": r6(F.col("distance")), "score": r6(F.col("score"))})


@query(f"WITH {X.ASKED_TWICE}, c AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS c FROM embeddings, q) SELECT query_id, id, round(c, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) <= 10")
def knn_cosine_topk(spark, d):
    return H.knn_cosine(X.vectors(spark, d), X.asked_twice(spark, d), 10).select("query_id", "id", r6(F.col("cosine")).alias("cosine"))


@query(f"WITH {LEGS}, {WEIGHTED} SELECT query_id, id, round(score, 6) AS score FROM fused")
def weighted_fusion(spark, d):
    return H.weighted(*_legs(spark, d)).select("query_id", "id", r6(F.col("score")).alias("score"))


@query(f"WITH {LEGS} SELECT query_id, id, round(sum(1.0 / (60 + rank)) / (2.0 / 61), 6) AS score FROM (SELECT query_id, id, rank FROM vec UNION ALL SELECT query_id, id, rank FROM kw) GROUP BY ALL")
def rrf_fusion(spark, d):
    return H.rrf(list(_legs(spark, d))).select("query_id", "id", r6(F.col("score")).alias("score"))


@query(f"WITH {LEGS}, {WEIGHTED}, {RARE}, z AS (SELECT f.query_id, f.id, leg, lr, score * {BOOSTS} AS score FROM fused f JOIN x USING (query_id) LEFT JOIN documents ON doc_id = f.id) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, leg, lr, id) AS rank, round(score, 6) AS score FROM z QUALIFY rank <= 10")
def hybrid_search_topk(spark, d):
    return H.hybrid(X.chunks(spark, d), X.vectors(spark, d), X.asked_twice(spark, d)).withColumn("score", r6(F.col("score")))


@query(f"""WITH {LEGS}, {WEIGHTED}, {RARE}, {X.OBS.replace("e AS (", "ev AS (", 1).replace("FROM e LEFT", "FROM ev LEFT")}, tide AS (SELECT id, 0.3 + 0.7 * ({BUOY}) AS factor FROM obs),
z AS (SELECT f.query_id, f.id, leg, lr, score * {BOOSTS} * CASE WHEN lang = 'en' THEN 1.1 ELSE 1.0 END * coalesce(factor, 1.0) AS score FROM fused f JOIN x USING (query_id) LEFT JOIN documents ON doc_id = f.id LEFT JOIN tide ON tide.id = f.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, leg, lr, id) AS rank, round(score, 6) AS score FROM z QUALIFY rank <= 10""")
def hybrid_branch_tide_topk(spark, d):
    from quarry.operators import passes

    docs = X.chunks(spark, d).withColumn("branch", F.col("channel"))
    asked = X.asked_twice(spark, d).withColumn("current_branch", F.lit("en"))
    return H.hybrid(docs, X.vectors(spark, d), asked, tide=passes.tides(X.observations(spark, d), NOW)).withColumn("score", r6(F.col("score")))


@query("WITH i AS (SELECT doc_id AS id, text, 'see src/app.py or fooBar and of_the' AS query FROM documents) SELECT id, least(2.0, 1.0 + 0.3 * (contains(text, 'src/app.py')::INT + contains(text, 'fooBar')::INT + contains(text, 'of_the')::INT))::DOUBLE AS boost FROM i")
def identifier_boost(spark, d):
    return X.chunks(spark, d).select("id", H.identifier_boost(F.lit("see src/app.py or fooBar and of_the"), F.col("text")).alias("boost"))


@query("SELECT doc_id AS id, CASE WHEN contains(text, 'License') OR contains(text, 'under') THEN 1.15 ELSE 1.0 END::DOUBLE AS boost FROM documents")
def rare_token_boost(spark, d):
    return X.chunks(spark, d).select("id", H.rare_boost(F.lit("what License, under the"), F.col("text")).alias("boost"))


HITS = X.OBS + ", h AS (SELECT id % 4 AS query_id, id, 1.0 / (1 + id % 97) AS score, created, superseded, CASE WHEN id % 3 = 0 THEN 'memory' ELSE 'observation' END AS channel FROM obs), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM h)"


def _hits(spark, d):
    from pyspark.sql import Window

    o = X.observations(spark, d)
    h = o.select((F.col("id") % 4).alias("query_id"), "id", (1.0 / (1 + F.col("id") % 97)).alias("score"), "created", "superseded", F.when(F.col("id") % 3 == 0, "memory").otherwise("observation").alias("channel"))
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")))


@query(f"""WITH {HITS}, z AS (SELECT *, rank <= 10 AS head, score * CASE WHEN channel = 'observation' THEN 0.5 + 0.5 * exp(-0.6931471805599453 * greatest(0.0, (1706745600 - created) / 86400.0) / 21) ELSE 1.0 END AS aged FROM r)
SELECT query_id, id, round(CASE WHEN head THEN aged ELSE score END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY (NOT head)::INT, CASE WHEN head THEN -round(score, 9) END, rank) AS rank FROM (SELECT * REPLACE (CASE WHEN head THEN aged ELSE score END AS score) FROM z)""")
def temporal_rerank(spark, d):
    return H.temporal_rerank(_hits(spark, d), NOW).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query(f"WITH {HITS}, z AS (SELECT query_id, id, rank, CASE WHEN superseded THEN score * 0.5 ELSE score END AS score FROM r) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS rank FROM z")
def supersede_demotion(spark, d):
    return H.demoted(_hits(spark, d)).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query(f"WITH {X.OBS} SELECT id, round(exp(-0.6931471805599453 * greatest(0.0, (1706745600 - created) / 86400.0) / 90), 6) AS factor FROM obs")
def recency_decay(spark, d):
    return X.observations(spark, d).select("id", r6(recency(F.lit(NOW) - F.col("created"), 90.0)).alias("factor"))


@query(f"WITH {HITS} SELECT query_id, r.id FROM r WHERE id NOT IN (SELECT id FROM obs WHERE archived)")
def drop_archived(spark, d):
    return H.without(_hits(spark, d), X.observations(spark, d).where("archived")).select("query_id", "id")


CENT = "c AS (SELECT vec_id AS cluster_id, embedding::DOUBLE[] AS centroid, 1 AS hits FROM embeddings ORDER BY vec_id LIMIT 8)"
NEAREST = "a AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, arg_max(cluster_id, (round(list_cosine_similarity(embedding::DOUBLE[], centroid), 9), -cluster_id)) AS cluster_id FROM embeddings, c GROUP BY ALL)"


def _centroids(spark, d):
    return X.vectors(spark, d).orderBy("id").limit(8).select(F.col("id").alias("cluster_id"), F.col("vector").cast("array<double>").alias("centroid"), F.lit(1).cast("long").alias("hits"))


@query(f"WITH {CENT}, {NEAREST} SELECT id, cluster_id FROM a")
def nearest_centroid(spark, d):
    return I.assigned(X.vectors(spark, d), _centroids(spark, d)).select("id", "cluster_id")


@query("WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings), m AS (SELECT label, pos, round(avg(x), 6) AS x FROM u GROUP BY ALL) SELECT label, pos::INT AS pos, x FROM m")
def centroid_by_label(spark, d):
    c = V.centroids(X.vectors(spark, d), "label", "vector")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", (F.col("pos") + 1).alias("pos"), r6(F.col("x")).alias("x"))


@query(f"""WITH {CENT}, {NEAREST}, u AS (SELECT cluster_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM a), m AS (SELECT cluster_id, pos, avg(x) AS mean, count(*) AS new FROM u GROUP BY ALL)
SELECT cluster_id, pos::INT AS pos, round(centroid[pos] + greatest(0.01, new / (hits + new)) * (mean - centroid[pos]), 6) AS x FROM c JOIN m USING (cluster_id)""")
def minibatch_update(spark, d):
    u = I.updated(X.vectors(spark, d), _centroids(spark, d))
    return u.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", (F.col("pos") + 1).alias("pos"), r6(F.col("x")).alias("x"))


@query(f"""WITH {X.ASKED_TWICE}, {CENT}, {NEAREST}, n AS (SELECT query_id, qv, cluster_id FROM q, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv::DOUBLE[], centroid), 9) DESC, cluster_id) <= 6),
x AS (SELECT query_id, id, list_distance(v, qv::DOUBLE[]) AS distance FROM n JOIN (SELECT id, v, CASE WHEN id % 10 = 0 THEN -1 ELSE cluster_id END AS cluster_id FROM a) USING (cluster_id) UNION ALL SELECT query_id, id, list_distance(v, qv::DOUBLE[]) FROM q, a WHERE id % 10 = 0)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank, round(distance, 6) AS distance FROM x QUALIFY rank <= 10""")
def ivf_probe(spark, d):
    # vectors here are all but unclustered: 6 of 8 clusters hold 0.92 of the true neighbours, 3 hold 0.68
    c = _centroids(spark, d)
    ivf = I.assigned(X.vectors(spark, d), c).withColumn("cluster_id", F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("cluster_id")))
    return I.probed(ivf, c, X.asked_twice(spark, d), k=10, probes=6).withColumn("distance", r6(F.col("distance")))


GRADED = "g AS (SELECT 'v' || (doc_id % 2) AS profile, doc_id // 20 AS query_id, doc_id AS id, quality + toxic + doc_id % 2 AS grade, doc_id * 7919 % 10007 AS created FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY created, id) AS rank FROM g)"


def _graded(spark, d):
    from pyspark.sql import Window

    g = X.table(spark, d, "labels").select(F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("profile"), F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic") + F.col("doc_id") % 2).alias("grade"), (F.col("doc_id") * 7919 % 10007).alias("created"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("profile", "query_id").orderBy("created", "id")))


@query(f"WITH {GRADED}, p AS (SELECT profile, query_id, coalesce(1.0 / min(rank) FILTER (grade >= 2), 0) AS rr FROM r GROUP BY ALL) SELECT profile, round(avg(rr), 6) AS mrr FROM p GROUP BY 1")
def mrr(spark, d):
    return E.mrr(_graded(spark, d)).withColumn("mrr", r6(F.col("mrr")))


@query(f"""WITH {GRADED}, b AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY grade DESC, rank) AS best FROM r),
p AS (SELECT profile, query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum((pow(2, grade) - 1) / log2(best + 1)) FILTER (best <= 10) AS idcg FROM b GROUP BY ALL)
SELECT profile, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg FROM p GROUP BY 1""")
def ndcg_at_k(spark, d):
    return E.ndcg(_graded(spark, d)).withColumn("ndcg", r6(F.col("ndcg")))


@query(f"WITH {GRADED}, p AS (SELECT profile, query_id, count(*) FILTER (grade >= 2 AND rank <= 5) AS hit, count(*) FILTER (grade >= 2) AS n FROM r GROUP BY ALL) SELECT profile, round(avg(CASE WHEN n > 0 THEN hit / n ELSE 0 END), 6) AS recall FROM p GROUP BY 1")
def recall_at_k(spark, d):
    return E.recall(_graded(spark, d), k=5).withColumn("recall", r6(F.col("recall")))


@query(f"""WITH {GRADED}, f AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY created DESC, id) = 1 AS fresh FROM r),
p AS (SELECT profile, query_id, max((rank = 1 AND fresh)::INT) AS first, avg((NOT fresh)::INT) AS stale FROM f WHERE rank <= 10 GROUP BY ALL) SELECT profile, round(avg(first), 6) AS freshness, round(avg(stale), 6) AS staleness FROM p GROUP BY 1""")
def freshness_staleness(spark, d):
    return E.freshness(_graded(spark, d)).select("profile", r6(F.col("freshness")).alias("freshness"), r6(F.col("staleness")).alias("staleness"))


@query(f"WITH {X.EVENTS}, a AS (SELECT event_type AS query FROM e) SELECT query, count(*) AS asked FROM a GROUP BY 1 ORDER BY asked DESC, query LIMIT 3")
def seeded_queries(spark, d):
    return E.seeded_queries(X.events(spark, d).select(F.col("event_type").alias("query")), 3)


@query(f"""WITH {X.EVENTS}, t AS (SELECT user_id AS session_id, event_id AS turn_id, t * 1000 AS ts FROM e WHERE src = 'auto'), i AS (SELECT user_id AS session_id, t * 1000 AS ts FROM e WHERE src = 'search')
SELECT t.session_id, turn_id, t.ts, max(i.ts) AS injected_ts FROM t LEFT JOIN i ON i.session_id = t.session_id AND abs(i.ts - t.ts) <= 3600000 GROUP BY ALL""")
def displacement_join(spark, d):
    e = X.events(spark, d)
    turns = e.where("src = 'auto'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_id"), (F.col("t") * 1000).alias("ts"))
    given = e.where("src = 'search'").select(F.col("user_id").alias("session_id"), (F.col("t") * 1000).alias("ts"))
    return E.displaced(turns, given, 3_600_000).select("session_id", "turn_id", "ts", "injected_ts")


@query("""WITH c AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id, greatest(n, 1) AS n, turn, role, text FROM c) SELECT conv_id, n::BIGINT AS turn_no, count(*) AS entries, min(turn) AS first_turn, sum(length(text))::BIGINT AS chars FROM s GROUP BY conv_id, n""")
def turn_sessions(spark, d):
    t = transcripts.turns(X.table(spark, d, "conversations"))
    return t.groupBy("conv_id", "turn_no").agg(F.count("*").alias("entries"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY id ORDER BY n) % 2 = 1 OR starts_with(line, '```') AS fenced FROM l),
h AS (SELECT *, sum((starts_with(line, '## ') AND NOT fenced)::INT) OVER (PARTITION BY id ORDER BY n) AS section FROM f)
SELECT id, section::BIGINT AS section, count(*) AS lines, max(fenced::INT)::BOOLEAN AS has_code FROM h GROUP BY id, section""")
def h2_sections(spark, d):
    return chunkers.h2_lines(X.chunks(spark, d)).groupBy("id", "section").agg(F.count("*").alias("lines"), F.max("fenced").alias("has_code"))


@query("SELECT doc_id AS id, 'memory:' || coalesce(source, '') || ':' || substr(sha256('memory' || chr(31) || coalesce(source, '') || chr(31) || doc_id), 1, 8) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    c = X.table(spark, d, "documents")
    return c.select(F.col("doc_id").alias("id"), T.chunk_id(F.lit("memory"), F.coalesce("source", F.lit("")), F.col("doc_id")).alias("chunk_id"))


def queries():
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
