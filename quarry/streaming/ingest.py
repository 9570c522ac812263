"""Streams that call the batch operators: event files to observations, usage to buckets, claims with leases."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import queueing

EVENT = "id long, session_id string, project_id string, prompt_number int, tool_name string, ts long, files array<string>"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 20) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def observations_to(stream: DataFrame, out: str, checkpoint: str):
    """Each micro-batch's events as observations, appended under its number, so that a repeated batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        queueing.observations(queueing.accepted(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_usage(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tokens by session and minute of a stream (session_id, at timestamp, tokens); later events than `late` are left out."""
    return stream.withWatermark("at", late).groupBy("session_id", F.window("at", "1 minute")).agg(F.sum("tokens").alias("tokens")).select("session_id", F.unix_seconds("window.start").alias("minute"), "tokens")


def live_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of a stream (id, session_id, at, ...) once each: ids are remembered as long as they may come late."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def captured(stream: DataFrame) -> DataFrame:
    """(session_id, n, text) of a stream of whole transcripts (session_id, entries array<string>): only entries beyond those
    that earlier versions of the session had. State is one number for each session."""
    import pandas as pd

    def run(key, batches, state):
        seen = state.get[0] if state.exists else 0
        longest: list = []
        for pdf in batches:
            longest = max([longest, *map(list, pdf["entries"])], key=len)
        state.update((max(seen, len(longest)),))
        new = longest[seen:]
        yield pd.DataFrame({"session_id": [key[0]] * len(new), "n": range(seen, seen + len(new)), "text": new})

    return stream.groupBy("session_id").applyInPandasWithState(run, "session_id string, n long, text string", "n long", "append", "NoTimeout")
