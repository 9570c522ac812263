"""The event queue: dedupe, batches, retries, leases and claims."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_delete(queue: DataFrame) -> DataFrame:
    """Ids of pending rows that repeat a done row, or another pending row of a lower id, in session and prompt.

    A null prompt gives a null key: it equals no done key, and pending null keys form one group.
    """
    key = F.concat("session_id", F.lit("|"), F.col("prompt_number").cast("string"))
    rows = queue.withColumn("key", key)
    pending, done = rows.where("status = 'pending'"), rows.where("status = 'done' and key is not null").select("key").distinct()
    again = pending.join(done, "key", "left_semi").select("id")
    first = pending.groupBy("key").agg(F.min("id").alias("first"))
    later = pending.join(first, pending["key"].eqNullSafe(first["key"])).where("id <> first").select("id")
    return again.union(later).distinct()


def accepted(events: DataFrame, longest: int = 2000) -> DataFrame:
    """Events that may be queued: with session, project and tool, a time, and a prompt number of 0 or more. Their summaries, where
    there are such columns, are cut to `longest` characters; missing lists of files are empty."""
    said = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    fine = said("session_id") & said("project_id") & said("tool_name") & F.col("ts").isNotNull() & (F.col("prompt_number") >= 0)
    cut = {c: F.substring(c, 1, longest) for c in ("tool_input_summary", "tool_result_summary") if c in events.columns}
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("files", "files_read", "files_modified") if c in events.columns}
    return events.where(fine).withColumns(cut | lists)


def observations(events: DataFrame) -> DataFrame:
    """One row for each session and prompt: scalars of the first event, files in order of first appearance."""
    first = lambda c: F.min_by(c, F.struct("ts", "id")).alias(c)
    files = F.array_sort(F.collect_list(F.struct("ts", "id", "files")))
    return events.groupBy("session_id", "prompt_number").agg(first("project_id"), first("tool_name"), F.count("*").alias("events"), F.array_distinct(F.flatten(F.transform(files, lambda x: x["files"]))).alias("files"))


def next_state(status: Column, outcome: Column, retries: Column, most: int = 3) -> Column:
    """status and retries after an attempt: an overloaded service costs no retry, a permanent failure ends at once."""
    new = (
        F.when(status != "processing", status)
        .when(outcome == "done", "done")
        .when(outcome == "overloaded", "pending")
        .when((outcome == "permanent") | (retries + 1 >= most), "failed")
        .otherwise("pending")
    )
    count = retries + F.when((status == "processing") & outcome.isin("retryable", "permanent"), 1).otherwise(0)
    return F.struct(new.alias("status"), count.alias("retries"))


def backoff_ms(streak: Column, jitter: Column, retry_after_ms: Column, base: int = 15_000, cap: int = 600_000) -> Column:
    """Half the capped exponential step plus a jittered half, or what the service asked for if that is longer."""
    step = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(F.lit(1), streak) - 1), F.lit(float(cap)))
    return F.greatest(F.round(step / 2 + jitter * (step / 2)), F.greatest(F.lit(0), retry_after_ms).cast("double")).cast("long")


def due(queue: DataFrame, now: int) -> DataFrame:
    return queue.where((F.col("status") == "pending") & (F.coalesce("next_retry", F.lit(0)) <= now)).orderBy("next_retry", "id")


def pruned(queue: DataFrame, before: int) -> DataFrame:
    """queue without rows that were done before a time; all that isn't done stays, whatever its age."""
    return queue.where(~F.coalesce((F.col("status") == "done") & (F.col("ts") < before), F.lit(False)))


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("rows"))


def failures(queue: DataFrame) -> DataFrame:
    bad = queue.where("last_error is not null")
    return bad.agg(F.count("*").alias("failed"), F.max_by("last_error", F.struct("last_error_at", "id")).alias("latest_error"))


def latest_claims(notes: DataFrame) -> DataFrame:
    """The last note of each session wins."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return notes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def lease_end(default_s: int = 1800, least: int = 60, most: int = 28_800) -> Column:
    """When the lease of a note (ts in ms, ttl_s) runs out; ttl is kept within least..most seconds."""
    return F.col("ts") + F.least(F.greatest(F.coalesce("ttl_s", F.lit(default_s)), F.lit(least)), F.lit(most)).cast("long") * 1000


def live(notes: DataFrame, now_ms: int, default_s: int = 1800, least: int = 60, most: int = 28_800) -> DataFrame:
    """Notes whose lease runs still; ttl is kept within least..most seconds."""
    ttl = F.least(F.greatest(F.coalesce("ttl_s", F.lit(default_s)), F.lit(least)), F.lit(most)).cast("long")
    return notes.withColumn("ttl_s", ttl).where(F.lit(now_ms) < F.col("ts") + F.col("ttl_s") * 1000)


def contention(notes: DataFrame) -> DataFrame:
    """Repositories that two sessions or more hold."""
    held = notes.where("repo_root is not null").groupBy("repo_root").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"))
    return held.where(F.size("sessions") >= 2).select("repo_root", F.size("sessions").cast("long").alias("n_sessions"))


def glob_base(glob: Column) -> Column:
    """(is_prefix, path) of a claim: a wildcard or a trailing slash claims the folder before it, * alone the whole tree."""
    g = F.regexp_replace(F.trim(F.coalesce(glob, F.lit(""))), r"^\./", "")
    bare = F.regexp_replace(g, "/+$", "")
    star = F.instr(bare, "*")
    prefix = g.isin("", "*", "**") | g.endswith("/") | (star > 0)
    path = F.when(g.isin("", "*", "**"), "").when(g.endswith("/") | (star == 0), bare).otherwise(F.regexp_replace(F.substring(bare, F.lit(1), star - 1), "/+$", ""))
    return F.struct(prefix.alias("prefix"), path.alias("path"))


def _ancestors(path: Column) -> Column:
    """The path and all folders above it, the whole tree ("") too."""
    parts = F.split(path, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def overlaps(claims: DataFrame) -> DataFrame:
    """(a, b, file_a, file_b), a < b: claims (session_id, repo_root, file) of two sessions in one repository that touch: of one path, or one within a
    folder that the other claims. Claims of folders meet others by equality with one of their ancestors, so only what touches is ever paired."""
    c = claims.where("repo_root is not null").select("session_id", "repo_root", "file", glob_base(F.col("file")).alias("g")).select("session_id", "repo_root", "file", "g.prefix", "g.path")
    above = c.where("prefix").select("repo_root", F.col("path").alias("above"), F.col("session_id").alias("s"), F.col("file").alias("f"))
    under = c.withColumn("above", F.explode(_ancestors(F.col("path")))).join(above, ["repo_root", "above"]).where("session_id <> s")
    # of two folders that are the same each is under the other
    under = under.where(~(F.col("prefix") & (F.col("path") == F.col("above"))) | (F.col("s") < F.col("session_id"))).select("s", "f", "session_id", "file")
    exact = c.where("not prefix").select("repo_root", "path", F.col("session_id").alias("s"), F.col("file").alias("f"))
    same = exact.join(exact.toDF("repo_root", "path", "session_id", "file"), ["repo_root", "path"]).where("s < session_id").select("s", "f", "session_id", "file")
    first = F.col("s") < F.col("session_id")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return under.union(same).select(pick("s", "session_id", "a"), pick("session_id", "s", "b"), pick("f", "file", "file_a"), pick("file", "f", "file_b"))
