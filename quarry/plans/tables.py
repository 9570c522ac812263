"""The driver's tables as the library's entities, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706745600  # 2024-02-01 UTC
TYPES = ("bugfix", "feature", "refactor", "discovery", "decision", "change")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, t, src, event_type, value, k): events with epoch seconds and what kind of surfacing they are."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    src = F.when(F.col("event_type") == "view", "auto").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "drill")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "user_id", t.alias("t"), src.alias("src"), "event_type", "value", k.alias("k"))


EVENTS = """e AS (SELECT event_id, user_id, cast(floor(epoch(ts)) AS BIGINT) AS t,
  CASE event_type WHEN 'view' THEN 'auto' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'drill' END AS src,
  event_type, value, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each user: counters from events, a title from part, the rest by rule from the id."""
    e = events(spark, sf_dir)
    n = lambda s: F.count(F.when(F.col("src") == s, 1)).alias(f"from_{s}")
    g = e.groupBy(F.col("user_id").alias("id")).agg(n("auto"), n("search"), n("drill"), F.min("t").alias("created"), F.max(F.when(F.col("src").isNotNull(), F.col("t"))).alias("last_surfaced"))
    g = g.withColumn("from_drill", F.when(F.col("id") % 3 == 0, F.col("from_drill")).otherwise(F.lit(0)))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    i = F.col("id")
    version = F.when(i % 4 == 0, F.concat(F.lit(" v1."), F.floor(i / 30 % 4).cast("string"), F.lit("."), (i % 7).cast("string"))).otherwise("")
    g = g.join(part, F.col("p_partkey") == i % 24 + 1, "left").withColumns(
        {
            "project_id": F.concat(F.lit("p"), (i % 5).cast("string")),
            "branch": F.when(i % 3 != 0, F.concat(F.lit("b"), (i % 3).cast("string"))),
            "session_id": F.concat(F.lit("s"), (i % 40).cast("string")),
            "type": F.element_at(F.array(*map(F.lit, TYPES)), (i % 6 + 1).cast("int")),
            "title": F.concat(F.coalesce("p_name", F.lit("")), version),
            "is_anchored": i % 17 == 0,
            "archived": i % 11 == 0,
            "tide_state": F.when(i % 7 == 5, "dormant").when(i % 7 == 6, "archived").otherwise("active"),
            "stability_days": F.when(i % 4 != 0, (i % 50 + 1).cast("double")),
            "superseded": i % 13 == 0,
            "origin_agent": F.when(i % 5 != 0, F.concat(F.lit("agent"), (i % 4).cast("string"))),
            "work_tokens": F.when(i % 3 != 0, i * 37 % 5000 + 100),
            "stored_tokens": F.when(i % 4 != 0, i * 11 % 900 + 20),
            "promoted_at": F.when(i % 9 == 0, F.lit(NOW).cast("long")),
        }
    )
    return g.drop("p_name", "p_partkey")


OBS = (
    EVENTS
    + """, obs AS (SELECT user_id AS id,
  count(*) FILTER (src = 'auto') AS from_auto, count(*) FILTER (src = 'search') AS from_search, CASE WHEN user_id % 3 = 0 THEN count(*) FILTER (src = 'drill') ELSE 0 END AS from_drill,
  min(t) AS created, max(t) FILTER (src IS NOT NULL) AS last_surfaced,
  'p' || (user_id % 5) AS project_id, CASE WHEN user_id % 3 <> 0 THEN 'b' || (user_id % 3) END AS branch, 's' || (user_id % 40) AS session_id,
  (['bugfix', 'feature', 'refactor', 'discovery', 'decision', 'change'])[user_id % 6 + 1] AS type,
  coalesce(p_name, '') || CASE WHEN user_id % 4 = 0 THEN ' v1.' || (user_id // 30 % 4) || '.' || (user_id % 7) ELSE '' END AS title,
  user_id % 17 = 0 AS is_anchored, user_id % 11 = 0 AS archived,
  CASE user_id % 7 WHEN 5 THEN 'dormant' WHEN 6 THEN 'archived' ELSE 'active' END AS tide_state,
  CASE WHEN user_id % 4 <> 0 THEN (user_id % 50 + 1)::DOUBLE END AS stability_days, user_id % 13 = 0 AS superseded,
  CASE WHEN user_id % 5 <> 0 THEN 'agent' || (user_id % 4) END AS origin_agent,
  CASE WHEN user_id % 3 <> 0 THEN user_id * 37 % 5000 + 100 END AS work_tokens, CASE WHEN user_id % 4 <> 0 THEN user_id * 11 % 900 + 20 END AS stored_tokens,
  CASE WHEN user_id % 9 = 0 THEN 1706745600 END AS promoted_at
  FROM e LEFT JOIN part ON p_partkey = user_id % 24 + 1 GROUP BY user_id, p_name)"""
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("channel"), F.col("source").alias("project_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword queries: whole texts of all benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with vectors: every vector whose id is divisible by 20, with the benchmark item of its number among these."""
    v = vectors(spark, sf_dir).where("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("query_id"), "vector")
    return asked(spark, sf_dir).join(v, "query_id", "right").withColumn("query", F.coalesce("query", F.lit("")))


ASKED = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
ASKED_TWICE = "q AS (SELECT vec_id // 20 AS query_id, coalesce(text, '') AS query, embedding AS qv FROM embeddings LEFT JOIN benchmark ON item_id = vec_id // 20 WHERE vec_id % 20 = 0)"


def audit(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    """Audit lines: events of a session (user) in so many hours are what one prompt was given. A line of one event is a corrupt one."""
    e = events(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / (3600 * hours)))
    g = e.groupBy("user_id", "hour").agg(F.max("t").alias("ts"), F.collect_set("k").alias("ids"), F.count("*").alias("n"))
    return g.select(F.concat_ws(":", F.col("user_id").cast("string"), F.col("hour").cast("string")).alias("line_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), "ts", F.when((F.col("user_id") % 10) != 0, F.col("ids")).alias("ids"), (F.col("n") * 100).alias("injected_tokens"))


AUDIT = (
    EVENTS
    + """, audit AS (SELECT user_id || ':' || (t // 3600) AS line_id, 's' || user_id AS session_id, max(t) AS ts,
  CASE WHEN user_id % 10 <> 0 THEN list(DISTINCT k) FILTER (k IS NOT NULL) END AS ids, count(*) * 100 AS injected_tokens FROM e GROUP BY user_id, t // 3600)"""
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"), F.concat(F.lit("s"), (F.col("o_custkey") % 100).cast("string")).alias("session_id"), (F.lit(NOW * 1000) - key % 5000 * 1000).alias("ts"),
        F.when(key % 3 != 0, (key % 40 * 100).cast("long")).alias("ttl_s"), F.when(key % 4 != 0, F.concat(F.lit("repo"), (key % 30).cast("string"))).alias("repo_root"),
        F.concat(F.lit("src/m"), (key % 12).cast("string"), F.when(key % 5 == 0, "/*").when(key % 5 == 1, "/").otherwise("/a.py")).alias("file"),
    )


NOTES = """notes AS (SELECT o_orderkey AS id, 's' || (o_custkey % 100) AS session_id, 1706745600000 - o_orderkey % 5000 * 1000 AS ts,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 40 * 100 END AS ttl_s, CASE WHEN o_orderkey % 4 <> 0 THEN 'repo' || (o_orderkey % 30) END AS repo_root,
  'src/m' || (o_orderkey % 12) || CASE o_orderkey % 5 WHEN 0 THEN '/*' WHEN 1 THEN '/' ELSE '/a.py' END AS file FROM orders)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    i = F.col("event_id")
    return e.select(
        i.alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.when(i % 9 != 0, F.col("k") % 5).alias("prompt_number"),
        F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "processing").otherwise("pending").alias("status"),
        (i % 4).alias("retries"), F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.when(i % 3 == 0, "429").when(i % 3 == 1, "401").otherwise("503"))).alias("last_error"),
        F.col("t").alias("last_error_at"), F.when(i % 2 == 0, F.col("t") + 600).alias("next_retry"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_id"),
        F.col("event_type").alias("tool_name"), F.col("t").alias("ts"), F.array(F.concat(F.lit("f"), (F.col("k") % 7).cast("string"))).alias("files"),
    )


QUEUE = (
    EVENTS
    + """, queue AS (SELECT event_id AS id, 's' || user_id AS session_id, CASE WHEN event_id % 9 <> 0 THEN k % 5 END AS prompt_number,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'processing' ELSE 'pending' END AS status, event_id % 4 AS retries,
  CASE WHEN event_type = 'error' THEN 'HTTP ' || CASE event_id % 3 WHEN 0 THEN '429' WHEN 1 THEN '401' ELSE '503' END END AS last_error, t AS last_error_at,
  CASE WHEN event_id % 2 = 0 THEN t + 600 END AS next_retry, 'p' || (user_id % 5) AS project_id, event_type AS tool_name, t AS ts, 'f' || (k % 7) AS file FROM e)"""
)
