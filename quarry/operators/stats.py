"""Reports over the corpus, its use and its cost."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def channel_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("channel").agg(F.count("*").alias("chunks"))


def recall_totals(records: DataFrame) -> DataFrame:
    total = F.col("from_auto") + F.col("from_search") + F.col("from_drill")
    return records.agg(
        F.count("*").alias("total"),
        F.count(F.when(total > 0, 1)).alias("surfaced"),
        F.count(F.when(F.col("from_drill") > 0, 1)).alias("recalled"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("from_auto", "from_search", "from_drill")),
    )


def by_origin(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("origin_agent", F.lit("unknown")).alias("origin")).agg(F.count("*").alias("records"))


def tide_stats(records: DataFrame, start_days: float = 7.0) -> DataFrame:
    """Active is what is neither dormant nor archived, unknown states included."""
    dormant, archived = (F.count(F.when(F.col("tide_state") == s, 1)) for s in ("dormant", "archived"))
    return records.agg(
        F.count("*").alias("total"),
        (F.count("*") - dormant - archived).alias("active"),
        dormant.alias("dormant"),
        archived.alias("archived"),
        F.count(F.when(F.col("stability_days") > start_days, 1)).alias("strengthened"),
        F.count(F.when(F.col("is_anchored"), 1)).alias("anchored"),
        F.max("stability_days").alias("max_stability"),
    )


def efficiency(records: DataFrame) -> DataFrame:
    """Compression over records that have both token counts; ratio to one place, saved_pct within 0..100."""
    both = F.col("work_tokens").isNotNull() & F.col("stored_tokens").isNotNull()
    s = records.agg(F.count("*").alias("total"), F.count(F.when(both, 1)).alias("paired"), F.sum(F.when(both, F.col("work_tokens"))).alias("work"), F.sum(F.when(both, F.col("stored_tokens"))).alias("stored"))
    fine = (F.col("work") > 0) & (F.col("stored") > 0)
    share = F.round((F.col("work") - F.col("stored")) / F.col("work") * 100)
    return s.select("total", "paired", "work", "stored", F.when(fine, F.round(F.col("work") / F.col("stored"), 1)).alias("ratio"), F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))).cast("long").alias("saved_pct"))


def last_activity(records: DataFrame) -> DataFrame:
    return records.agg(F.max(F.greatest(F.coalesce("last_surfaced", F.lit(0)), "created")).alias("last_activity"))


def injected_by_session(audit: DataFrame) -> DataFrame:
    return audit.groupBy("session_id").agg(F.sum("injected_tokens").alias("injected"), F.count("*").alias("injections"), F.min("ts").alias("first_ts"))


def usage_by_session(usage: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Token sums per session; a message told several times counts once, with the largest of each field."""
    once = usage.groupBy("session_id", "message_id").agg(*(F.max(f).alias(f) for f in fields))
    return once.groupBy("session_id").agg(F.count("*").alias("messages"), *(F.sum(f).alias(f) for f in fields))


def usage_totals(usage: DataFrame, since: int) -> DataFrame:
    """One row of usage (session_id, parent_id, ts, fresh, output, cached): sessions and sub-agents, which have a parent, counted
    apart; the oldest last activity; token sums of all time, and as window_* those from `since` on. Sums over nothing are 0."""
    fields = ("fresh", "output", "cached")
    inside = {f"window_{f}": F.when(F.col("ts") >= since, F.col(f)) for f in fields}
    sums = lambda names: [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    per = usage.withColumns(inside).groupBy("session_id").agg(F.max("parent_id").alias("parent_id"), F.max("ts").alias("last"), *sums((*fields, *inside)))
    return per.agg(F.count(F.when(F.col("parent_id").isNull(), 1)).alias("sessions"), F.count("parent_id").alias("agents"), F.min("last").alias("oldest"), *sums((*fields, *inside)))


def migration_counts(progress: DataFrame) -> DataFrame:
    """(kind, records) of an import's progress (kind, source_id, ...): both kinds, also those of which nothing was imported; others don't count."""
    kinds = F.explode(F.array(F.lit("observation"), F.lit("summary"))).alias("kind")
    some = progress.groupBy("kind").agg(F.count("*").alias("n"))
    both = progress.sparkSession.range(1).select(kinds)
    return both.join(some, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("records"))


def minute_buckets(events: DataFrame, since: int) -> DataFrame:
    """Tokens by session and minute, from `since` (epoch seconds) on."""
    minute = F.floor(F.col("ts") / 60) * 60
    return events.where(F.col("ts") >= since).groupBy("session_id", minute.cast("long").alias("minute")).agg(F.sum("tokens").alias("tokens"))


def audit_digest(audit: DataFrame) -> DataFrame:
    """One row of an audit log (line_id, ts, ids; ids null where a line is corrupt, which still counts as an entry)."""
    from quarry.operators.similarity import co_retrieval

    lines = audit.agg(F.count("*").alias("entries"), F.max("ts").alias("last_ts"))
    pairs = co_retrieval(audit.where("ids is not null")).agg(F.count("*").alias("pairs"))
    docs = audit.select(F.explode("ids").alias("id")).agg(F.countDistinct("id").alias("covered"))
    return lines.crossJoin(pairs).crossJoin(docs)


def session_report(sessions: DataFrame, injected: DataFrame) -> DataFrame:
    return sessions.join(injected.select("session_id", "injected"), "session_id", "left").withColumn("injected", F.coalesce("injected", F.lit(0)))


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and exact median of each key."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def trailing(buckets: DataFrame, seconds: int) -> DataFrame:
    """Each bucket with its session's sum over the last `seconds`."""
    w = Window.partitionBy("session_id").orderBy("minute").rangeBetween(-seconds, 0)
    return buckets.withColumn("window_tokens", F.sum("tokens").over(w))
