"""Sources and sinks: file changes, transcripts of several tools, a legacy import, logs and manifests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.transcripts import without_repeats


def changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """(source_path, change) between two snapshots (source_path, sha): added, changed or removed."""
    j = current.select("source_path", F.col("sha").alias("new")).join(known.select("source_path", F.col("sha").alias("old")), "source_path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.select("source_path", kind.alias("change")).where("change is not null")


def without_documents(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """chunks (or vectors) of documents that are still there: deleting a document takes what belongs to it along."""
    return chunks.join(removed.select("document_id"), "document_id", "left_anti")


def settled(files: DataFrame, now: int, ingested: DataFrame, quiet: int = 60) -> DataFrame:
    """files (path, mtime, marker) that nobody wrote to for a while and whose marker wasn't ingested."""
    return files.where(F.col("mtime") <= now - quiet).join(ingested.select("path", "marker"), ["path", "marker"], "left_anti")


def rollout_entries(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, place, role, text, tool) of rollout JSON lines: user and agent messages and tool calls, corrupt lines left out."""
    schema = "timestamp string, type string, payload struct<type:string,role:string,message:string,name:string,arguments:string>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())
    p = F.col("payload.type")
    role = F.when(p == "user_message", "user").when(p.isin("agent_message", "function_call"), "assistant")
    return rows.select(F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1).alias("session_id"), F.col("timestamp").alias("place"), role.alias("role"), F.coalesce("payload.message", "payload.arguments").alias("text"), F.col("payload.name").alias("tool")).where("role is not null")


def role_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, role, text) of JSON lines with a role and content."""
    rows = spark.read.schema("role string, content string").option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())
    return rows.where("role in ('user', 'assistant')").select(F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1).alias("session_id"), "role", F.col("content").alias("text"))


def printable_pieces(blobs: DataFrame, least: int = 4, size: int = 2000, most: int = 8) -> DataFrame:
    """(id, piece, text) of binary blobs (id, content): printable runs of four and more, lines repeated at once taken once,
    in at most eight pieces of 2000 characters."""
    text = F.decode(F.col("content"), "ISO-8859-1")
    runs = F.regexp_extract_all(text, F.lit(r"[\t\n -~]{" + str(least) + ",}"), F.lit(0))
    lines = blobs.select("id", F.posexplode(F.split(F.array_join(runs, "\n"), "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    kept = without_repeats(lines, "id", "n").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("t"))
    n = F.least(F.ceil(F.length("t") / size).cast("int"), F.lit(most))
    return kept.select("id", "t", F.explode(F.sequence(F.lit(1), n)).alias("piece")).select("id", "piece", F.substring(F.col("t"), (F.col("piece") - 1) * size + 1, F.lit(size)).alias("text"))


def legacy_records(rows: DataFrame, done: DataFrame, project: str) -> DataFrame:
    """Records of an older store (times in milliseconds, lists as JSON) that weren't imported yet; done is (id)."""
    todo = rows.join(done.select("id"), "id", "left_anti")
    lists = [F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("facts", "concepts", "files_read", "files_modified")]
    return todo.select("id", F.col("memory_session_id").alias("session_id"), F.lit(project).alias("project_id"), "type", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("narrative", F.lit("")).alias("narrative"), *lists, F.floor(F.col("created_at_epoch") / 1000).alias("created"))


def summary_chunks(rows: DataFrame) -> DataFrame:
    """(id, field, text): the parts of a session's summary that say something, one chunk each."""
    fields = ("request", "investigated", "learned", "completed", "next_steps", "notes")
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(f, F.lit(""))).alias("text")) for f in fields))
    return rows.select("id", F.explode(parts).alias("p")).select("id", "p.field", "p.text").where("text <> ''")


def append_log(lines: DataFrame, path: str, day: str) -> None:
    """Append lines under their day; a day is a folder, so old ones are dropped whole."""
    lines.withColumn("day", F.lit(day)).write.mode("append").partitionBy("day").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """(source_path, sha, bytes) of files read as binary: what a backup has to hold."""
    return files.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes"))
