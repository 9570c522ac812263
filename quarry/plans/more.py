"""Further queries: hydration, records and texts, folds by meaning, and what prompts are given."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import context as C
from quarry.operators import index as I
from quarry.operators import queueing as Q
from quarry.operators import records as R
from quarry.operators import semantic as G
from quarry.operators import similarity as M
from quarry.operators import stats as S
from quarry.plans import tables as X
from quarry.plans.core import CO, CO_SIM, TOTAL, query, r6
from quarry.sources import chunkers, transcripts


@query(f"WITH {X.OBS} SELECT id, session_id, created FROM obs ORDER BY created DESC, id DESC LIMIT 15")
def list_recent(spark, d):
    return X.observations(spark, d).orderBy(F.desc("created"), F.desc("id")).limit(15).select("id", "session_id", "created")


@query(f"WITH {X.OBS} SELECT session_id, arg_max(id, (created, id)) AS id FROM obs GROUP BY 1")
def latest_for_session(spark, d):
    return X.observations(spark, d).groupBy("session_id").agg(F.max_by("id", F.struct("created", "id")).alias("id"))


@query(f"WITH {X.OBS} SELECT id, title FROM obs WHERE NOT archived AND contains(lower(title), 'v1.2')")
def title_search(spark, d):
    return R.viewed(X.observations(spark, d), "all", title="V1.2").select("id", "title")


@query(f"WITH {X.OBS} SELECT id, project_id FROM obs WHERE type = 'feature' AND list_has_any(list_value(session_id), ['s1', 's7', 's13'])")
def file_filter(spark, d):
    from quarry.operators import passes

    o = X.observations(spark, d).withColumn("files", F.array("session_id"))
    return o.where((F.col("type") == "feature") & passes.touching(F.col("files"), ["s1", "s7", "s13"])).select("id", "project_id")


@query("SELECT d.doc_id AS id, d.source AS project_id, l.quality, count(*) AS turns FROM documents d JOIN labels l USING (doc_id) JOIN conversations c ON c.conv_id = d.doc_id GROUP BY ALL")
def hydrate(spark, d):
    docs, labels = X.chunks(spark, d).select("id", "project_id"), X.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    turns = X.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"))
    return docs.join(labels, "id").join(turns, "id")


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 10 = 0")
def upsert(spark, d):
    old = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return R.upserted(old, old.where("id % 10 = 0").withColumn("source", F.lit("new")), "id")


@query("SELECT event_id AS id FROM events WHERE cast(json_extract_string(props, '$.k') AS BIGINT) IN (1, 5, 9)")
def json_filter(spark, d):
    return X.table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("long").isin(1, 5, 9)).select(F.col("event_id").alias("id"))


@query("""WITH l AS (SELECT event_id AS seq, 'k_' || (user_id % 200) AS key, CASE WHEN event_type <> 'error' THEN user_id || ':' || event_type END AS value FROM events)
SELECT key, arg_max(struct_pack(v := value), seq).v AS value FROM l WHERE starts_with(key, 'k_1') GROUP BY key HAVING arg_max(struct_pack(v := value), seq).v IS NOT NULL""")
def kv_prefix(spark, d):
    from quarry.operators import kv

    e = X.table(spark, d, "events")
    value = F.when(F.col("event_type") != "error", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    return kv.listed(e.select(F.col("event_id").alias("seq"), F.concat(F.lit("k_"), (F.col("user_id") % 200).cast("string")).alias("key"), value.alias("value")), "k_1")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey * p_size < 1024 THEN (p_partkey * p_size) || ' B' WHEN p_partkey * p_size < 1048576 THEN printf('%.1f KB', round(p_partkey * p_size / 1024.0, 1)) ELSE printf('%.1f MB', round(p_partkey * p_size / 1048576.0, 1)) END AS bytes,
CASE WHEN p_partkey * p_size < 60 THEN (p_partkey * p_size) || 's' WHEN p_partkey * p_size < 3600 THEN (p_partkey * p_size // 60) || 'm ' || (p_partkey * p_size % 60) || 's' ELSE (p_partkey * p_size // 3600) || 'h ' || (p_partkey * p_size % 3600 // 60) || 'm' END AS elapsed,
strftime(make_timestamp((p_partkey::BIGINT * p_size * 864 // 10) * 1000000), '%Y-%m-%d') AS day FROM part""")
def number_texts(spark, d):
    n = F.col("p_partkey").cast("long") * F.col("p_size")
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.bytes_text(n).alias("bytes"), T.elapsed_text(n).alias("elapsed"), T.day_text(F.floor(n * 864 / 10)).alias("day"))


@query(f"WITH {X.OBS} SELECT id, CASE WHEN type IN ('bugfix', 'feature', 'refactor', 'discovery', 'decision') THEN type ELSE 'change' END AS type FROM obs")
def coerced_types(spark, d):
    return R.coerced(X.observations(spark, d)).select("id", "type")


@query(f"WITH {X.OBS} SELECT id, tide_state AS was, CASE WHEN tide_state IN ('dormant', 'archived') THEN 'active' ELSE tide_state END AS tide_state FROM obs")
def restored(spark, d):
    return R.restored(X.observations(spark, d)).select("id", "was", "tide_state")


@query(f"WITH {X.QUEUE} SELECT id FROM queue WHERE NOT (status = 'done' AND ts < 1705500000)")
def pruned_queue(spark, d):
    return Q.pruned(X.queue(spark, d), 1705500000).select("id")


@query(f"WITH {X.OBS} SELECT id % 10 AS survivor_id, count(*) AS members FROM obs GROUP BY 1")
def merged_survivors(spark, d):
    return R.survivors(X.observations(spark, d).select((F.col("id") % 10).alias("survivor_id"), "id"))


@query(f"WITH {X.OBS} SELECT project_id, sum(from_auto)::BIGINT AS from_auto, max(last_surfaced) AS last_surfaced, string_agg(id::VARCHAR, ',' ORDER BY id) AS cluster_key FROM obs GROUP BY 1")
def theme_sums(spark, d):
    o = X.observations(spark, d)
    return o.groupBy("project_id").agg(F.sum("from_auto").alias("from_auto"), F.max("last_surfaced").alias("last_surfaced"), G.cluster_key(F.collect_list("id")).alias("cluster_key"))


@query("WITH c AS (SELECT label, count(*) * 2 AS hits FROM embeddings WHERE label % 3 = 0 GROUP BY 1), n AS (SELECT count(*) AS vectors FROM embeddings), t AS (SELECT count(*) AS clusters, sum(hits) AS told FROM c) SELECT clusters, vectors, least(told, vectors)::BIGINT AS assigned FROM t, n")
def index_summary(spark, d):
    v = X.vectors(spark, d)
    hits = v.where("label % 3 = 0").groupBy(F.col("label").alias("cluster_id")).agg((F.count("*") * 2).alias("hits"))
    return I.summary(v, hits)


@query(f"WITH {X.EVENTS}, t AS (SELECT user_id AS conv_id, event_id AS n, event_type AS line, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) SELECT conv_id, n, line FROM t WHERE before IS NULL OR before <> line")
def dedupe_lines(spark, d):
    e = X.events(spark, d).select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("n"), F.col("event_type").alias("line"))
    return transcripts.without_repeats(e, "conv_id", "n")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place > conv_id % 4")
def cursor_slice(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn")
    return transcripts.beyond(c, c.select("conv_id").distinct().withColumn("n", F.col("conv_id") % 4), "conv_id", "turn").select("conv_id", "turn")


@query(f"WITH {X.EVENTS}, t AS (SELECT user_id AS s, event_id AS n, CASE WHEN event_id % 3 = 0 THEN t END AS ts FROM e) SELECT s, n, last_value(ts IGNORE NULLS) OVER (PARTITION BY s ORDER BY n ROWS UNBOUNDED PRECEDING) AS ts FROM t")
def carried_times(spark, d):
    e = X.events(spark, d).select(F.col("user_id").alias("s"), F.col("event_id").alias("n"), F.when(F.col("event_id") % 3 == 0, F.col("t")).alias("ts"))
    return transcripts.carried(e, "s", "n")


@query(f"WITH {X.EVENTS}, b AS (SELECT 's' || user_id AS session_id, t // 60 * 60 AS minute, sum(k)::BIGINT AS tokens FROM e GROUP BY 1, 2) SELECT session_id, minute, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY minute RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS window_tokens FROM b")
def trailing_usage(spark, d):
    e = X.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("t").alias("ts"), F.col("k").alias("tokens"))
    return S.trailing(S.minute_buckets(e, 0), 86400)


@query(f"WITH {X.AUDIT}, i AS (SELECT session_id, sum(injected_tokens)::BIGINT AS injected FROM audit WHERE ids IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT session_id FROM audit) SELECT session_id, coalesce(injected, 0) AS injected FROM s LEFT JOIN i USING (session_id)")
def session_usage(spark, d):
    a = X.audit(spark, d)
    return S.session_report(a.select("session_id").distinct(), S.injected_by_session(a.where("ids is not null")))


USAGE = X.EVENTS + """, u AS (SELECT 's' || user_id AS session_id, CASE WHEN user_id % 4 <> 0 THEN 's' || (user_id // 4) END AS parent_id, t AS ts, coalesce(k, 0) AS fresh, coalesce(k % 7, 0) AS output, coalesce(k * 2, 0) AS cached FROM e)"""


@query(f"""WITH {USAGE}, s AS (SELECT session_id, max(parent_id) AS parent_id, max(ts) AS last FROM u GROUP BY 1),
w AS (SELECT * FROM u WHERE ts >= 1705500000)
SELECT count(*) FILTER (parent_id IS NULL) AS sessions, count(parent_id) AS agents, min(last) AS oldest, (SELECT sum(fresh)::BIGINT FROM u) AS fresh, (SELECT sum(output)::BIGINT FROM u) AS output, (SELECT sum(cached)::BIGINT FROM u) AS cached,
(SELECT coalesce(sum(fresh), 0)::BIGINT FROM w) AS window_fresh, (SELECT coalesce(sum(output), 0)::BIGINT FROM w) AS window_output, (SELECT coalesce(sum(cached), 0)::BIGINT FROM w) AS window_cached FROM s""")
def fleet_totals(spark, d):
    user, k = F.col("user_id"), F.coalesce("k", F.lit(0))
    parent = F.when(user % 4 != 0, F.concat(F.lit("s"), F.floor(user / 4).cast("string")))
    u = X.events(spark, d).select(F.concat(F.lit("s"), user.cast("string")).alias("session_id"), parent.alias("parent_id"), F.col("t").alias("ts"), k.alias("fresh"), (k % 7).alias("output"), (k * 2).alias("cached"))
    return S.usage_totals(u, 1705500000)


@query(f"WITH {X.EVENTS}, p AS (SELECT CASE WHEN event_type = 'view' THEN 'observation' WHEN event_type = 'error' THEN 'other' END AS kind FROM e) SELECT k.kind, count(p.kind) AS records FROM (VALUES ('observation'), ('summary')) k(kind) LEFT JOIN p USING (kind) GROUP BY 1")
def migration_counts(spark, d):
    kind = F.when(F.col("event_type") == "view", "observation").when(F.col("event_type") == "error", "other")
    return S.migration_counts(X.events(spark, d).select(kind.alias("kind"), F.col("event_id").alias("source_id")))


def _vectors(spark, d):
    return X.vectors(spark, d).select("id", "vector")


VEC = "ov AS (SELECT obs.*, embedding::DOUBLE[] AS v FROM obs JOIN embeddings ON vec_id = id)"
ALIKE = "ov AS (SELECT obs.*, embedding::DOUBLE[] AS v FROM obs JOIN embeddings ON vec_id = CASE WHEN id % 7 = 0 THEN id ELSE id % 120 END)"


def _alike(spark, d, apart=120):
    at = F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("id") % apart)
    return X.observations(spark, d).select("id", at.alias("vec_id")).join(_vectors(spark, d).withColumnRenamed("id", "vec_id"), "vec_id").select("id", "vector")


@query(f"WITH {X.OBS}, {VEC} SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM ov x JOIN ov y ON x.project_id = y.project_id AND x.branch IS NOT DISTINCT FROM y.branch AND x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.1")
def scoped_cosine_pairs(spark, d):
    return G.alike(X.observations(spark, d), _vectors(spark, d), ("project_id", "branch"), 0.1, None).withColumn("cosine", r6(F.col("cosine")))


@query()
def semantic_folds(spark, d):
    return G.semantic_folds(X.observations(spark, d).withColumn("session_id", F.col("project_id")), _alike(spark, d))


@query()
def theme_clusters(spark, d):
    from quarry.plans.core import _similar

    # in lines of a week records meet often enough for the threshold to tell them apart
    together = _similar(spark, d, hours=168).select("a", "b", F.col("co").alias("similarity"))
    return G.theme_clusters(X.observations(spark, d), _alike(spark, d, 15), together)


@query(f"WITH {X.OBS}, {VEC} SELECT x.session_id AS a, y.session_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM ov x JOIN ov y ON x.project_id = y.project_id AND x.session_id < y.session_id WHERE round(list_cosine_similarity(x.v, y.v), 6) >= 0.25")
def semantic_overlap(spark, d):
    return G.semantic_overlaps(X.observations(spark, d).withColumn("repo_root", F.col("project_id")), _vectors(spark, d), 0.25)


@query("""WITH n AS (SELECT vec_id AS id, 'f' || vec_id AS file, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
k AS (SELECT x.vec_id AS id, 'f' || (x.vec_id - 101) AS file, list_transform(y.embedding::DOUBLE[], lambda z: z * (1 + 0.02 * (x.vec_id % 5))) AS v FROM embeddings x JOIN embeddings y ON y.vec_id = CASE WHEN x.vec_id % 20 IN (7, 8, 13) THEN x.vec_id - x.vec_id % 20 ELSE x.vec_id END WHERE x.vec_id % 20 <> 0),
s AS (SELECT n.id, min(k.id) AS same_id FROM n JOIN k USING (file) GROUP BY 1),
c AS (SELECT n.id, arg_max(k.id, (round(1 - list_distance(n.v, k.v), 9), -k.id)) AS near_id FROM n, k WHERE round(1 - list_distance(n.v, k.v), 9) >= 0.85 AND n.id NOT IN (SELECT id FROM s) GROUP BY 1)
SELECT n.id, CASE WHEN same_id IS NULL AND near_id IS NULL THEN 'create' ELSE 'update' END AS action, coalesce(same_id, near_id) AS target_id FROM n LEFT JOIN s USING (id) LEFT JOIN c USING (id)""")
def memory_targets(spark, d):
    v = _vectors(spark, d)
    i = F.col("id")
    new = v.where("id % 20 = 0").withColumn("file", F.concat(F.lit("f"), i.cast("string")))
    of = F.when((i % 20).isin(7, 8, 13), i - i % 20).otherwise(i)
    known = v.where("id % 20 <> 0").select("id", of.alias("of")).join(v.withColumnRenamed("id", "of"), "of")
    known = known.select("id", F.concat(F.lit("f"), (i - 101).cast("string")).alias("file"), F.transform("vector", lambda z: z.cast("double") * (1 + 0.02 * (i % 5))).alias("vector"))
    return G.write_targets(new, known)


@query("SELECT doc_id // 4 AS id, round(avg(x), 6) AS first FROM (SELECT vec_id AS doc_id, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY 1")
def representative_vectors(spark, d):
    r = G.representative_vectors(_vectors(spark, d).withColumn("id", F.floor(F.col("id") / 4)))
    return r.select("id", r6(F.col("vector")[0]).alias("first"))


@query("SELECT greatest(1, round(count(*) / 300.0))::BIGINT AS clusters FROM embeddings")
def cluster_count(spark, d):
    return spark.createDataFrame([(I.cluster_count(_vectors(spark, d).count()),)], "clusters long")


@query()
def ivf_build(spark, d):
    v = X.vectors(spark, d)
    c = I.seeds(v, I.cluster_count(v.count(), 100))
    c = I.updated(v, c)
    return I.assigned(v, c).groupBy("cluster_id").agg(F.count("*").alias("vectors"))


@query("SELECT doc_id AS id, length(text) < 10 OR lower(trim(text)) IN ('ok', 'continue', 'yes', 'go', 'next', 'sure') AS noop, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(last|latest|newest|current|most[ -]recent|recent|up[ -]to[ -]date|now)($|[^A-Za-z0-9_])') AS temporal FROM documents")
def prompt_gates(spark, d):
    return X.chunks(spark, d).select("id", T.is_noop(F.col("text")).alias("noop"), T.asks_for_recent(F.col("text")).alias("temporal"))


@query("SELECT page_id AS id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugs(spark, d):
    return X.table(spark, d, "pages").select(F.col("page_id").alias("id"), T.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 2000 THEN text[1:1999] || '…' ELSE text END AS text FROM documents")
def clipped(spark, d):
    return X.chunks(spark, d).select("id", T.clip(F.col("text")).alias("text"))


@query("""SELECT page_id AS id, CASE page_id % 8 WHEN 0 THEN 'codex' WHEN 1 THEN 'gemini' WHEN 2 THEN 'cursor' WHEN 3 THEN 'claude' WHEN 4 THEN 'opencode' WHEN 5 THEN 'copilot' WHEN 6 THEN 'agents' ELSE 'other' END AS tool FROM pages""")
def tool_of_path(spark, d):
    paths = ("/h/.codex/a.md", "/h/.gemini/b.md", "/h/x/rule.mdc", "/h/x/CLAUDE.md", "/h/opencode/c.md", "/h/.github/copilot-instructions.md", "/h/AGENTS.md", "/h/x.md")
    p = F.element_at(F.array(*map(F.lit, paths)), (F.col("page_id") % 8 + 1).cast("int"))
    return X.table(spark, d, "pages").select(F.col("page_id").alias("id"), T.tool_of(p).alias("tool"))


@query("SELECT doc_id AS id, 'memory' AS channel, 'a:b' AS source, 'x' || doc_id AS short FROM documents")
def id_parts(spark, d):
    p = T.id_parts(F.concat(F.lit("memory:a:b:x"), F.col("id").cast("string")))
    return X.chunks(spark, d).select("id", p.alias("p")).select("id", "p.channel", "p.source", "p.short")


@query(r"SELECT doc_id AS id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))::INT AS tokens FROM documents")
def token_counts(spark, d):
    return X.chunks(spark, d).select("id", C.token_count(F.col("text")).alias("tokens"))


@query("SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS grade FROM pages")
def judge_grades(spark, d):
    reply = F.element_at(F.array(*map(F.lit, ("grade: 2", "9 of 10", "none", "1."))), (F.col("page_id") % 4 + 1).cast("int"))
    return X.table(spark, d, "pages").select(F.col("page_id").alias("id"), C.grade(reply).alias("grade"))


@query(f"WITH {X.OBS} SELECT id, '[' || type || '] ' || title || chr(10) || chr(10) || 'of ' || session_id || chr(10) || chr(10) || '• ' || project_id AS text FROM obs WHERE title <> ''")
def observation_chunks(spark, d):
    o = X.observations(spark, d).where("title <> ''")
    return o.select("id", chunkers.observation_text(F.col("type"), F.col("title"), F.concat(F.lit(" of "), "session_id"), F.array("project_id")).alias("text"))


@query()
def split_chunks(spark, d):
    return chunkers.split_for_limit(X.chunks(spark, d), 512).groupBy("id").agg(F.count("*").alias("pieces"))


@query()
def envelopes(spark, d):
    from pyspark.sql import Window

    h = X.chunks(spark, d).select(F.floor(F.col("id") / 12).alias("query_id"), F.element_at(F.array(*map(F.lit, C.CHANNELS)), (F.col("id") % 4 + 1).cast("int")).alias("channel"), F.concat(F.lit("doc "), F.col("id").cast("string")).alias("title"), F.col("text").alias("snippet"), (1.0 / (1 + F.col("id"))).alias("score"), "id")
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    return C.envelopes(h)


@query(f"WITH {CO} SELECT a, b, round(1 - (0.625 * {CO_SIM} + 0.375 * exp(-abs(na.first - nb.first) / 604800.0)), 6) AS distance FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 1 - (0.625 * {CO_SIM} + 0.375 * exp(-abs(na.first - nb.first) / 604800.0)) <= 0.8")
def near_in_use(spark, d):
    from quarry.plans.core import _similar

    s = _similar(spark, d).select("a", "b", (1 - M.blended(F.col("co"), F.col("time"))).alias("distance"))
    return s.where("distance <= 0.8").withColumn("distance", r6(F.col("distance")))


@query(f"WITH {X.OBS} SELECT id, {TOTAL} AS total, is_anchored OR from_drill > 0 AS protected FROM obs")
def protected(spark, d):
    return X.observations(spark, d).select("id", (F.col("from_auto") + F.col("from_search") + F.col("from_drill")).alias("total"), (F.col("is_anchored") | (F.col("from_drill") > 0)).alias("protected"))


#: records whose titles can be alike have ids 120 apart: all but each seventh share a vector with these


@query()
def dedup_pass(spark, d):
    from quarry.operators import passes

    return passes.dedup_merges(X.observations(spark, d), _alike(spark, d))


@query(f"""WITH {X.OBS}, {ALIKE}, v AS (SELECT id, project_id, branch, created, v, regexp_extract(title, ' v1\\.([0-9]+)\\.', 1) AS mi, regexp_extract(title, ' v1\\.[0-9]+\\.([0-9]+)', 1) AS pa, regexp_replace(title, ' v1\\.[0-9]+\\.[0-9]+', '') AS entity FROM ov),
t AS (SELECT * REPLACE (mi::BIGINT AS mi, pa::BIGINT AS pa) FROM v WHERE mi <> ''), h AS (SELECT *, first(id) OVER w AS hid, first(mi) OVER w AS hm, first(pa) OVER w AS hp, first(created) OVER w AS hc FROM t WINDOW w AS (PARTITION BY project_id, branch, entity ORDER BY mi DESC, pa DESC, id))
SELECT h.id, hid AS superseded_by FROM h JOIN ov o ON o.id = hid WHERE (mi, pa) < (hm, hp) AND h.created <= hc AND round(list_cosine_similarity(h.v, o.v), 9) >= 0.93""")
def supersede_pass(spark, d):
    from quarry.operators import passes

    return passes.supersessions(X.observations(spark, d), _alike(spark, d))


@query()
def collapsed_titles(spark, d):
    from quarry.operators import passes

    return passes.collapsed(X.observations(spark, d), 0.3)


@query()
def injected_context(spark, d):
    from quarry.operators import passes

    docs, o = X.chunks(spark, d).withColumn("channel", F.when(F.col("id") % 2 == 0, "observation").otherwise("memory")), X.observations(spark, d)
    hits = passes.injected(docs, X.vectors(spark, d), X.asked_twice(spark, d), o, X.NOW)
    return hits.select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


@query()
def search_by_channel(spark, d):
    from quarry.operators import passes

    return passes.search_channel(X.chunks(spark, d), X.vectors(spark, d), X.asked_twice(spark, d), "en").select("query_id", "id", "rank")


@query()
def profile_results(spark, d):
    from quarry.operators import passes

    return passes.by_profile(X.chunks(spark, d), X.vectors(spark, d), X.asked_twice(spark, d)).select("profile", "query_id", "id", "rank")


@query("WITH c AS (SELECT 'd' || doc_id AS p, sha256(text) AS sha FROM documents WHERE doc_id % 5 <> 0), k AS (SELECT 'd' || doc_id AS p, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(c.p, k.p) AS source_path, CASE WHEN k.p IS NULL THEN 'added' WHEN c.p IS NULL THEN 'removed' ELSE 'changed' END AS change FROM c FULL JOIN k ON c.p = k.p WHERE c.sha IS DISTINCT FROM k.sha")
def file_changes(spark, d):
    from quarry.sources import files

    f = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_path"), F.sha2("text", 256).alias("sha"))
    known = f.where("doc_id % 7 <> 0").withColumn("sha", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("sha")))
    return files.changes(f.where("doc_id % 5 <> 0"), known)


@query("WITH n AS (SELECT unnest(['license', 'the', 'und']) AS entity), h AS (SELECT entity, doc_id AS id, row_number() OVER (PARTITION BY entity ORDER BY n_chars DESC, doc_id) AS r FROM documents, n WHERE contains(lower(text), entity)) SELECT entity, id, r > 1 AS stale FROM h")
def entity_staleness(spark, d):
    from quarry.operators import evaluation

    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("created"))
    return evaluation.entity_staleness(docs, spark.createDataFrame([("license",), ("the",), ("und",)], "entity string"))


@query(f"WITH {X.EVENTS}, t AS (SELECT user_id, k, src = 'search' AS injected FROM e WHERE src IS NOT NULL) SELECT injected, count(*) AS turns, round(avg(k), 6) AS mean, quantile_cont(k, 0.5)::DOUBLE AS median FROM t GROUP BY 1")
def displacement_report(spark, d):
    from quarry.operators import evaluation

    e = X.events(spark, d).where("src is not null").select(F.when(F.col("src") == "search", F.col("t")).alias("injected_ts"), F.col("k").alias("calls"))
    return evaluation.displacement(e).withColumn("mean", r6(F.col("mean")))


@query("WITH p AS (SELECT page_id AS id, unnest(['request', 'learned', 'notes']) AS field, unnest([url, CASE WHEN page_id % 2 = 0 THEN 'x' ELSE '' END, trim(' n ')]) AS text FROM pages) SELECT * FROM p WHERE text <> ''")
def summary_chunks(spark, d):
    from quarry.sources import files

    p = X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("request"), F.lit(None).cast("string").alias("investigated"), F.when(F.col("page_id") % 2 == 0, "x").otherwise("").alias("learned"), F.lit("  ").alias("completed"), F.lit(None).cast("string").alias("next_steps"), F.lit(" n ").alias("notes"))
    return files.summary_chunks(p)
