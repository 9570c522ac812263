"""Transcripts: entries of a session, cut into turns, read with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE = T.StructType().add("timestamp", "string").add("cwd", "string").add("type", "string").add(
    "message", T.StructType().add("id", "string").add("model", "string").add("usage", T.StructType().add("input_tokens", "long").add("output_tokens", "long").add("cache_creation_input_tokens", "long").add("cache_read_input_tokens", "long"))
)
USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def usage_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, message_id, ts, token counts) of JSON-lines transcripts; a file is a session, and corrupt lines are left out."""
    rows = spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())
    session = F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1)
    fields = [F.coalesce(f"message.usage.{f}", F.lit(0)).cast("long").alias(f) for f in USAGE_FIELDS]
    return rows.where("message.usage is not null").select(session.alias("session_id"), F.col("message.id").alias("message_id"), F.unix_seconds(F.try_to_timestamp("timestamp")).alias("ts"), *fields)


def turns(entries: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """entries without system ones, with turn_no: each user entry begins a turn, what comes before the first belongs to turn 1."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("role") == "user").cast("long")).over(w)
    return entries.where(F.col("role") != "system").withColumn("turn_no", F.greatest(n, F.lit(1).cast("long")))


def carried(entries: DataFrame, key: str, order: str, ts: str = "ts") -> DataFrame:
    """entries with a missing time replaced by the last known one of their session."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn(ts, F.last(ts, ignorenulls=True).over(w))


def beyond(entries: DataFrame, ingested: DataFrame, key: str, order: str) -> DataFrame:
    """Entries after the number of each session that is ingested already (key, n)."""
    w = Window.partitionBy(key).orderBy(order)
    j = entries.withColumn("place", F.row_number().over(w)).join(ingested, key, "left")
    return j.where(F.col("place") > F.coalesce("n", F.lit(0))).drop("n", "place")


def without_repeats(lines: DataFrame, key: str, order: str, text: str = "line") -> DataFrame:
    """lines without those equal to the one before."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(text))).drop("before")


def json_messages(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, place, role, text) of JSON documents that hold a list of messages."""
    schema = "sessionId string, messages array<struct<type:string,role:string,content:string,timestamp:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    m = rows.select(F.col("sessionId").alias("session_id"), F.posexplode("messages").alias("place", "m"))
    return m.select("session_id", "place", F.coalesce("m.role", "m.type").alias("role"), F.col("m.content").alias("text"))


def joined_parts(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, message_id, role, text): relational transcripts, parts of a message in order of time."""
    body = parts.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "part_id", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return sessions.select("session_id").join(messages, "session_id").join(body, "message_id").select("session_id", "message_id", "role", "text")
