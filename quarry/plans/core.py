"""Queries over records, queues, claims and usage, each with its SQL."""

from pyspark.sql import functions as F

from quarry.functions import lifecycle as L
from quarry.functions import text as T
from quarry.operators import queueing as Q
from quarry.operators import records as R
from quarry.operators import similarity as M
from quarry.operators import stats as S
from quarry.plans import tables as X

NOW = X.NOW
ALL: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), with SQL for the same rows."""

    def keep(f):
        ALL[f.__name__] = (f, sql)
        return f

    return keep


def r6(c):
    return F.round(c, 6)


TOTAL = "(from_auto + from_search + from_drill)"
BUOY = "CASE WHEN is_anchored THEN 1.0 ELSE 1.0 / (1.0 + 0.15 * greatest(0.0, (1706745600 - coalesce(last_surfaced, created))::DOUBLE / 86400) / coalesce(stability_days, 7.0)) END"


@query("SELECT lang AS channel, count(*) AS chunks FROM documents GROUP BY lang")
def corpus_stats(spark, d):
    return S.channel_counts(X.chunks(spark, d))


@query(f"WITH {X.OBS} SELECT count(*) AS total, count(*) FILTER ({TOTAL} > 0) AS surfaced, count(*) FILTER (from_drill > 0) AS recalled, sum(from_auto)::BIGINT AS from_auto, sum(from_search)::BIGINT AS from_search, sum(from_drill)::BIGINT AS from_drill FROM obs")
def recall_totals(spark, d):
    return S.recall_totals(X.observations(spark, d))


@query(f"WITH {X.OBS} SELECT coalesce(origin_agent, 'unknown') AS origin, count(*) AS records FROM obs GROUP BY 1")
def origin_counts(spark, d):
    return S.by_origin(X.observations(spark, d))


@query(f"WITH {X.OBS} SELECT count(*) AS total, count(*) FILTER (tide_state NOT IN ('dormant', 'archived')) AS active, count(*) FILTER (tide_state = 'dormant') AS dormant, count(*) FILTER (tide_state = 'archived') AS archived, count(*) FILTER (stability_days > 7) AS strengthened, count(*) FILTER (is_anchored) AS anchored, max(stability_days) AS max_stability FROM obs")
def tide_stats(spark, d):
    return S.tide_stats(X.observations(spark, d))


@query(f"""WITH {X.OBS}, s AS (SELECT count(*) AS total, count(*) FILTER (work_tokens IS NOT NULL AND stored_tokens IS NOT NULL) AS paired,
  sum(work_tokens) FILTER (stored_tokens IS NOT NULL)::BIGINT AS work, sum(stored_tokens) FILTER (work_tokens IS NOT NULL)::BIGINT AS stored FROM obs)
SELECT total, paired, work, stored, round(work / stored, 1) AS ratio, greatest(0, least(100, round((work - stored) / work * 100)))::BIGINT AS saved_pct FROM s""")
def efficiency(spark, d):
    return S.efficiency(X.observations(spark, d))


@query(f"WITH {X.OBS} SELECT max(greatest(coalesce(last_surfaced, 0), created)) AS last_activity FROM obs")
def last_activity(spark, d):
    return S.last_activity(X.observations(spark, d))


@query(f"WITH {X.OBS} SELECT id, {TOTAL} AS total, last_surfaced FROM obs WHERE NOT archived AND from_drill > 0 ORDER BY total DESC, last_surfaced DESC NULLS LAST, id DESC LIMIT 20 OFFSET 10")
def recall_page(spark, d):
    return R.page(X.observations(spark, d), "recalled", offset=10, limit=20).select("id", "total", "last_surfaced")


@query(f"WITH {X.OBS} SELECT id, title FROM obs WHERE id IN (3, 5, 8)")
def point_lookup(spark, d):
    return X.observations(spark, d).where(F.col("id").isin(3, 5, 8)).select("id", "title")


@query(f"WITH {X.OBS} SELECT id, title, last_surfaced FROM obs WHERE tide_state = 'dormant' ORDER BY last_surfaced DESC NULLS LAST, id LIMIT 50")
def by_tide_state(spark, d):
    return X.observations(spark, d).where("tide_state = 'dormant'").orderBy(F.desc_nulls_last("last_surfaced"), "id").limit(50).select("id", "title", "last_surfaced")


@query(f"WITH {X.OBS} SELECT id FROM obs WHERE tide_state = 'active' AND NOT is_anchored AND from_drill = 0 AND coalesce(last_surfaced, created) < 1706745600 ORDER BY coalesce(last_surfaced, created), id LIMIT 256")
def tier_candidates(spark, d):
    return R.sweep_candidates(X.observations(spark, d), "active", NOW).select("id")


@query(f"WITH {X.OBS} SELECT id FROM obs WHERE promoted_at IS NULL AND NOT archived AND type IN ('decision', 'feature', 'discovery') AND {TOTAL} >= 1 ORDER BY created DESC, id DESC LIMIT 5")
def promotion_candidates(spark, d):
    return R.promotion_candidates(X.observations(spark, d)).select("id")


@query(f"WITH {X.OBS} SELECT id, round({BUOY}, 6) AS buoyancy, round(0.3 + 0.7 * ({BUOY}), 6) AS multiplier FROM obs")
def buoyancy(spark, d):
    o = X.observations(spark, d)
    b = L.buoyancy(F.col("stability_days"), F.col("last_surfaced"), F.col("created"), F.col("is_anchored"), NOW)
    return o.select("id", r6(b).alias("buoyancy"), r6(L.multiplier(b)).alias("multiplier"))


@query(f"""WITH {X.OBS} SELECT id, CASE WHEN is_anchored OR from_drill > 0 THEN tide_state
  WHEN tide_state = 'active' AND {BUOY} < 0.3 AND (1721745600 - coalesce(last_surfaced, created)) / 86400.0 > 90 THEN 'dormant'
  WHEN tide_state = 'dormant' AND {BUOY} < 0.05 AND (1721745600 - coalesce(last_surfaced, created)) / 86400.0 > 180 THEN 'archived' ELSE tide_state END AS tide_state FROM obs""".replace("1706745600 - coalesce(last", "1721745600 - coalesce(last"))
def tide_tier(spark, d):
    return R.swept(X.observations(spark, d), NOW + 15_000_000).select("id", "tide_state")


@query(f"""WITH RECURSIVE {X.OBS}, ev AS (SELECT user_id AS id, src, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e WHERE src IS NOT NULL),
f AS (SELECT id, coalesce(stability_days, 7.0) AS s, 0 AS n FROM obs UNION ALL
  SELECT f.id, least(365.0, s * (1.0 + 0.5 * CASE src WHEN 'auto' THEN 0.5 WHEN 'search' THEN 1.0 ELSE 1.5 END * 365.0 / (365.0 + s))), ev.n FROM f JOIN ev ON ev.id = f.id AND ev.n = f.n + 1)
SELECT id, round(max_by(s, n), 6) AS stability_days FROM f GROUP BY id""")
def stability_fold(spark, d):
    log = X.events(spark, d).where("src is not null").select(F.col("user_id").alias("id"), F.col("t").alias("ts"), F.col("event_id").alias("seq"), "src")
    o = R.bumped(X.observations(spark, d), log)
    return o.select("id", r6(F.coalesce("stability_days", F.lit(7.0))).alias("stability_days"))


@query(f"""WITH {X.OBS}, v AS (SELECT id, project_id, branch, created, regexp_extract(title, ' v1\\.([0-9]+)\\.[0-9]+', 1) AS minor, regexp_extract(title, ' v1\\.[0-9]+\\.([0-9]+)', 1) AS patch, regexp_replace(title, ' v1\\.[0-9]+\\.[0-9]+', '') AS rest FROM obs),
t AS (SELECT id, project_id, branch, created, minor::BIGINT AS minor, patch::BIGINT AS patch, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(rest), '[^a-z0-9]+'), lambda x: len(x) >= 3))), ' ') AS entity FROM v WHERE minor <> ''),
h AS (SELECT *, first(id) OVER w AS head_id, first(minor) OVER w AS hm, first(patch) OVER w AS hp, first(created) OVER w AS hc FROM t WHERE entity <> '' WINDOW w AS (PARTITION BY project_id, branch, entity ORDER BY minor DESC, patch DESC, id))
SELECT id, head_id, entity FROM h WHERE (minor, patch) < (hm, hp) AND created <= hc""")
def supersede_candidates(spark, d):
    return R.supersede_candidates(X.observations(spark, d))


@query(f"WITH {X.OBS}, live AS (SELECT * FROM obs WHERE NOT archived AND {TOTAL} > 0) SELECT id, session_id FROM live WHERE session_id IN (SELECT session_id FROM live GROUP BY 1 HAVING count(*) > 1)")
def same_session_rows(spark, d):
    return R.same_session(X.observations(spark, d)).select("id", "session_id")


@query(f"""WITH {X.OBS}, g AS (SELECT *, min(id) OVER (PARTITION BY project_id, branch, type) AS survivor FROM obs)
SELECT survivor AS id, sum(from_auto)::BIGINT AS from_auto, sum(from_search)::BIGINT AS from_search, sum(from_drill)::BIGINT AS from_drill, max(last_surfaced) AS last_surfaced FROM g GROUP BY survivor""")
def merge_fold(spark, d):
    from pyspark.sql import Window

    o = X.observations(spark, d)
    groups = o.select("id", F.min("id").over(Window.partitionBy("project_id", "branch", "type")).alias("survivor_id"))
    events = R.merge_events(o, groups)
    survivors = groups.select(F.col("survivor_id").alias("id")).distinct()
    return R.merged(o, events).join(survivors, "id", "left_semi").select("id", "from_auto", "from_search", "from_drill", "last_surfaced")


@query(f"WITH {X.OBS} SELECT id, from_auto, from_search, from_drill, last_surfaced, archived FROM obs")
def merge_undo(spark, d):
    from pyspark.sql import Window

    o = X.observations(spark, d)
    groups = o.select("id", F.min("id").over(Window.partitionBy("project_id", "branch", "type")).alias("survivor_id"))
    groups = groups.join(o.where("not archived").select("id"), "id", "left_semi")
    events = R.merge_events(o, groups)
    return R.unmerged(R.merged(o, events), events, o.select("id", "last_surfaced")).select("id", "from_auto", "from_search", "from_drill", "last_surfaced", "archived")


TOKS = "list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), '[^a-z0-9]+'), lambda x: len(x) >= 3)))"


@query(f"""WITH {X.OBS}, t AS (SELECT min(id) AS id, project_id, branch, {TOKS} AS toks FROM obs GROUP BY project_id, branch, toks HAVING len(toks) > 0)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))), 6) AS similarity FROM t a JOIN t b ON a.id < b.id AND a.project_id = b.project_id AND a.branch IS NOT DISTINCT FROM b.branch
WHERE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.3""")
def title_jaccard_pairs(spark, d):
    return M.title_pairs(X.observations(spark, d), 0.3)


@query()
def title_groups(spark, d):
    return M.title_groups(X.observations(spark, d))


@query(f"WITH {X.AUDIT}, one AS (SELECT line_id, unnest(ids) AS id FROM audit) SELECT x.id AS a, y.id AS b, count(*) AS together FROM one x JOIN one y ON x.line_id = y.line_id AND x.id < y.id GROUP BY 1, 2")
def co_retrieval_pairs(spark, d):
    return M.co_retrieval(X.audit(spark, d).where("ids is not null"))


CO = X.AUDIT + ", one AS (SELECT line_id, ts, unnest(ids) AS id FROM audit), n AS (SELECT id, count(*) AS n, min(ts) AS first FROM one GROUP BY 1), p AS (SELECT x.id AS a, y.id AS b, count(*) AS together FROM one x JOIN one y ON x.line_id = y.line_id AND x.id < y.id GROUP BY 1, 2)"
CO_SIM = "least(1.0, together::DOUBLE / (na.n + nb.n - together))"


def _similar(spark, d, hours=1):
    lines = X.audit(spark, d, hours).where("ids is not null")
    n = lines.select("ts", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    p = M.co_retrieval(lines)
    for side in "ab":
        p = p.join(n.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("first").alias(f"t_{side}")), side)
    co, time = M.co_similarity(F.col("together"), F.col("n_a"), F.col("n_b")), M.time_similarity(F.col("t_a"), F.col("t_b"))
    return p.select("a", "b", co.alias("co"), time.alias("time"))


@query(f"WITH {CO} SELECT a, b, round({CO_SIM}, 6) AS co, round(exp(-abs(na.first - nb.first) / 604800.0), 6) AS time, round(0.625 * {CO_SIM} + 0.375 * exp(-abs(na.first - nb.first) / 604800.0), 6) AS blended FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b")
def weighted_similarity(spark, d):
    return _similar(spark, d).select("a", "b", r6(F.col("co")).alias("co"), r6(F.col("time")).alias("time"), r6(M.blended(F.col("co"), F.col("time"))).alias("blended"))


@query()
def dream_clusters(spark, d):
    s = _similar(spark, d)
    ids = s.select(F.col("a").alias("id")).union(s.select("b")).distinct()
    return M.dbscan(ids, s.select("a", "b", (1 - M.blended(F.col("co"), F.col("time"))).alias("distance")))


@query(f"WITH {X.AUDIT}, one AS (SELECT line_id, unnest(ids) AS id FROM audit) SELECT (SELECT count(*) FROM audit) AS entries, (SELECT max(ts) FROM audit) AS last_ts, (SELECT count(*) FROM (SELECT DISTINCT x.id, y.id FROM one x JOIN one y ON x.line_id = y.line_id AND x.id < y.id)) AS pairs, (SELECT count(DISTINCT id) FROM one) AS covered")
def audit_digest(spark, d):
    return S.audit_digest(X.audit(spark, d))


@query(f"WITH {X.AUDIT} SELECT session_id, sum(injected_tokens)::BIGINT AS injected, count(*) AS injections, min(ts) AS first_ts FROM audit GROUP BY 1")
def injected_by_session(spark, d):
    return S.injected_by_session(X.audit(spark, d))


@query(f"WITH {X.EVENTS}, m AS (SELECT user_id, k % 20 AS m, max(round(value)::BIGINT) AS tokens FROM e GROUP BY 1, 2) SELECT 's' || user_id AS session_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens FROM m GROUP BY 1")
def msgid_dedupe_usage(spark, d):
    e = X.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), (F.col("k") % 20).alias("message_id"), F.round("value").cast("long").alias("tokens"))
    return S.usage_by_session(e, ("tokens",))


@query(f"WITH {X.EVENTS} SELECT 's' || user_id AS session_id, t // 60 * 60 AS minute, sum(k)::BIGINT AS tokens FROM e WHERE t >= 1704067200 GROUP BY 1, 2")
def minute_buckets(spark, d):
    e = X.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("t").alias("ts"), F.col("k").alias("tokens"))
    return S.minute_buckets(e, 1704067200)


@query(f"WITH {X.EVENTS} SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM e GROUP BY 1")
def mean_median(spark, d):
    return S.spread(X.events(spark, d), "event_type", "value").select("event_type", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"))


@query(f"""WITH {X.QUEUE}, k AS (SELECT *, session_id || '|' || prompt_number AS key FROM queue)
SELECT id FROM k WHERE status = 'pending' AND (key IN (SELECT key FROM k WHERE status = 'done' AND key IS NOT NULL) OR id NOT IN (SELECT min(id) FROM k WHERE status = 'pending' GROUP BY key))""")
def queue_dedupe(spark, d):
    return Q.to_delete(X.queue(spark, d))


@query(f"WITH {X.QUEUE} SELECT status, count(*) AS rows FROM queue GROUP BY 1")
def queue_status(spark, d):
    return Q.status_counts(X.queue(spark, d))


@query(f"WITH {X.QUEUE} SELECT count(*) AS failed, arg_max(last_error, (last_error_at, id)) AS latest_error FROM queue WHERE last_error IS NOT NULL")
def failure_state(spark, d):
    return Q.failures(X.queue(spark, d))


@query(f"WITH {X.QUEUE} SELECT last_error, CASE WHEN last_error LIKE '%429%' THEN 'rate_limited' WHEN last_error LIKE '%401%' THEN 'auth' ELSE 'unreachable' END AS class, count(*) AS rows FROM queue WHERE last_error IS NOT NULL GROUP BY 1, 2")
def failure_classes(spark, d):
    q = X.queue(spark, d).where("last_error is not null")
    return q.groupBy("last_error", T.failure_class(F.col("last_error")).alias("class")).agg(F.count("*").alias("rows"))


@query(f"WITH {X.QUEUE} SELECT id FROM queue WHERE status = 'pending' AND coalesce(next_retry, 0) <= 1705000000")
def due_retries(spark, d):
    return Q.due(X.queue(spark, d), 1705000000).select("id")


@query(f"WITH {X.QUEUE}, o AS (SELECT id, CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'overloaded' WHEN 2 THEN 'retryable' ELSE 'permanent' END AS outcome, status, retries FROM queue) SELECT id, CASE WHEN status <> 'processing' THEN status WHEN outcome = 'done' THEN 'done' WHEN outcome = 'overloaded' THEN 'pending' WHEN outcome = 'permanent' OR retries + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, retries + CASE WHEN status = 'processing' AND outcome IN ('retryable', 'permanent') THEN 1 ELSE 0 END AS retries FROM o")
def retry_states(spark, d):
    q = X.queue(spark, d).withColumn("outcome", F.element_at(F.array(*map(F.lit, ("done", "overloaded", "retryable", "permanent"))), (F.col("id") % 4 + 1).cast("int")))
    return q.select("id", Q.next_state(F.col("status"), F.col("outcome"), F.col("retries")).alias("s")).select("id", "s.status", "s.retries")


@query(f"WITH {X.QUEUE} SELECT id, greatest(round(least(15000.0 * pow(2, greatest(1, retries) - 1), 600000.0) * 0.75)::BIGINT, (id % 40) * 1000) AS wait_ms FROM queue")
def retry_backoff(spark, d):
    return X.queue(spark, d).select("id", Q.backoff_ms(F.col("retries"), F.lit(0.5), F.col("id") % 40 * 1000).alias("wait_ms"))


@query(f"""WITH {X.QUEUE}, f AS (SELECT session_id, prompt_number, file, min((ts, id)) AS first FROM queue GROUP BY ALL)
SELECT session_id, prompt_number, arg_min(project_id, (ts, id)) AS project_id, arg_min(tool_name, (ts, id)) AS tool_name, count(*) AS events,
  (SELECT string_agg(file, ',' ORDER BY first) FROM f WHERE f.session_id = q.session_id AND f.prompt_number IS NOT DISTINCT FROM q.prompt_number) AS files FROM queue q GROUP BY session_id, prompt_number""")
def dedupe_files(spark, d):
    return Q.observations(X.queue(spark, d)).withColumn("files", F.array_join("files", ","))


@query(f"WITH {X.NOTES}, l AS (SELECT *, least(greatest(coalesce(ttl_s, 1800), 60), 28800) AS t FROM notes QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) = 1) SELECT id, session_id, t AS ttl_s FROM l WHERE 1706745600000 < ts + t * 1000")
def lease_active(spark, d):
    return Q.live(Q.latest_claims(X.notes(spark, d)), NOW * 1000).select("id", "session_id", "ttl_s")


@query(f"WITH {X.NOTES} SELECT repo_root, count(DISTINCT session_id) AS n_sessions FROM notes WHERE repo_root IS NOT NULL GROUP BY 1 HAVING count(DISTINCT session_id) >= 2")
def repo_contention(spark, d):
    return Q.contention(X.notes(spark, d))


@query(f"""WITH {X.NOTES}, l AS (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) = 1),
g AS (SELECT session_id, repo_root, file, file NOT LIKE '%.py' AS prefix, regexp_replace(regexp_replace(file, '\\*$', ''), '/$', '') AS path FROM l)
SELECT a.session_id AS a, b.session_id AS b, a.file AS file_a, b.file AS file_b FROM g a JOIN g b ON a.repo_root = b.repo_root AND a.session_id < b.session_id
WHERE a.path = b.path OR (a.prefix AND starts_with(b.path, a.path || '/')) OR (b.prefix AND starts_with(a.path, b.path || '/'))""")
def glob_overlap(spark, d):
    return Q.overlaps(Q.latest_claims(X.notes(spark, d)))


@query("WITH b AS (SELECT sha256(text) AS sha, 'd' || doc_id AS source_path, doc_id FROM documents) SELECT source_path, sha FROM b WHERE doc_id % 3 <> 0")
def sha_skip(spark, d):
    files = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_path"), F.sha2("text", 256).alias("sha"))
    return R.changed(files, files.where("doc_id % 3 = 0")).select("source_path", "sha")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)")
def orphan_vectors(spark, d):
    from quarry.operators.index import orphans

    return orphans(X.vectors(spark, d), X.chunks(spark, d).where("id % 4 <> 0"))
