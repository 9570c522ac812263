"""Rollout transcripts, plain or zstd-compressed: lines, entries and turns."""

import re
from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: bytes of text that are held at once; a file that breaks off may lose so many before the break
_CHUNK = 1 << 16
_ID = r"-(\w{8}-\w{4}-\w{4}-\w{4}-\w{12})\.jsonl(?:\.zst)?$"


def _open(path: str):
    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return store.open_input_stream(at, compression=None)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, n, line, error) of each file: compressed ones are decompressed frame by frame as they are read, a chunk at a time."""
    for batch in batches:
        for path in batch["path"].to_pylist():
            n, rest, error = 0, b"", None

            def told(lines: list[bytes], error: str | None = None) -> pa.RecordBatch:
                text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines] if error is None else [None]
                k = len(text)
                return pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array(range(n, n + k), pa.int64()), pa.array(text, pa.string()), pa.array([error] * k, pa.string())], names=["path", "n", "line", "error"])

            try:
                with _open(path) as raw, pa.CompressedInputStream(raw, "zstd") if path.endswith(".zst") else nullcontext(raw) as source:
                    while block := source.read(_CHUNK):
                        *lines, rest = (rest + block).split(b"\n")
                        if lines:
                            yield told(lines)
                            n += len(lines)
            except OSError as e:
                error = str(e)
            if rest:
                yield told([rest])
                n += 1
            if error is not None:
                yield told([], error)


def lines(spark: SparkSession, path: str, pattern: str = "rollout-*.jsonl*") -> DataFrame:
    """(path, n, line, error) of all rollout files under a folder. A task reads one file after another and holds a chunk and a line of it. A file that
    breaks off, or can't be read, ends with a row that has no line but the error, so that no session is lost in silence."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    # names only: contents aren't loaded; long files go first
    dealt = found.repartitionByRange(F.col("length").desc(), "path")
    return dealt.select("path").mapInArrow(_lines_of, "path string, n long, line string, error string")


_CALL = "struct<server:string,tool:string,arguments:string>"
_PAYLOAD = f"timestamp string, type string, payload struct<type:string,message:string,content:string,name:string,input:string,arguments:string,last_agent_message:string,stdout:string,invocation:{_CALL}>"


def _clip(c: F.Column, most: int) -> F.Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def entries(rows: DataFrame) -> DataFrame:
    """(session_id, n, ts, kind, text, files) of lines (path, n, line): kind is user, part or patch. Lines that aren't JSON and payloads of other types
    are left out; files are those that a patch changed."""
    j = rows.where("line is not null").select("path", "n", F.from_json("line", _PAYLOAD).alias("o")).where("o.payload is not null")
    p, kind = "o.payload", F.col("o.payload.type")
    joined = F.array_join(F.transform(F.from_json(F.col(f"{p}.content"), "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    said = F.coalesce(F.col(f"{p}.message"), joined, F.col(f"{p}.content"), F.lit(""))
    blank = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")) == 0
    inv = f"{p}.invocation"
    part = (
        F.when((kind == "agent_message") & ~blank(said), F.concat(F.lit("assistant: "), said))
        .when((kind == "task_complete") & ~blank(F.col(f"{p}.last_agent_message")), F.concat(F.lit("result: "), F.col(f"{p}.last_agent_message")))
        .when(kind.isin("custom_tool_call", "function_call"), F.concat(F.coalesce(F.col(f"{p}.name"), F.lit("tool")), F.lit("("), _clip(F.coalesce(F.col(f"{p}.input"), F.col(f"{p}.arguments")), 300), F.lit(")")))
        .when(kind == "mcp_tool_call_end", F.concat(F.coalesce(F.col(f"{inv}.server"), F.lit("mcp")), F.lit(":"), F.coalesce(F.col(f"{inv}.tool"), F.lit("tool")), F.lit("("), _clip(F.coalesce(F.col(f"{inv}.arguments"), F.lit("{}")), 300), F.lit(")")))
        .when(kind == "patch_apply_end", F.lit("applied a code patch"))
    )
    files = F.when(kind == "patch_apply_end", F.regexp_extract_all(F.coalesce(F.col(f"{p}.stdout"), F.lit("")), F.lit(r"(?m)^[^\S\n]*[MAD][^\S\n]+(/\S[^\r\n]*?)[^\S\n]*\r?$"), F.lit(1)))
    session = F.when(F.regexp_extract("path", _ID, 1) != "", F.regexp_extract("path", _ID, 1)).otherwise(F.col("path"))
    label = F.when(kind == "user_message", "user").when(kind == "patch_apply_end", "patch").otherwise("part")
    text = F.when(kind == "user_message", F.coalesce(F.col(f"{p}.message"), F.lit(""))).otherwise(part)
    return j.select(session.alias("session_id"), "n", F.unix_seconds(F.try_to_timestamp("o.timestamp")).alias("ts"), label.alias("kind"), text.alias("text"), F.coalesce(files, F.array().cast("array<string>")).alias("files")).where("text is not null and (o.type is null or o.type <> 'session_meta')")


def turns(rows: DataFrame, longest: int = 2000) -> DataFrame:
    """(session_id, prompt_number, tool_input_summary, tool_result_summary, files_modified, ts) of entries: a user's message begins a turn, and so does
    the first entry of a session. Turns with neither text nor parts are left out; a turn's time is that of the last entry with one up to its first."""
    w = Window.partitionBy("session_id").orderBy("n")
    seen = rows.withColumn("known", F.last("ts", True).over(w)).withColumn("i", F.row_number().over(w))
    number = F.sum(F.when((F.col("kind") == "user") | (F.col("i") == 1), 1).otherwise(0)).over(w)
    seen = seen.withColumn("prompt_number", number.cast("int"))
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") != "user", F.struct("n", "text"))))
    files = F.array_sort(F.collect_list(F.struct("n", "files")))
    g = seen.groupBy("session_id", "prompt_number").agg(F.max(F.when(F.col("kind") == "user", F.col("text"))).alias("said"), parts.alias("parts"), files.alias("files"), F.min_by("known", "n").alias("ts"))
    result = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    told = g.select("session_id", "prompt_number", _clip(F.col("said"), longest).alias("tool_input_summary"), _clip(result, longest).alias("tool_result_summary"), F.array_distinct(F.flatten(F.transform("files", lambda x: x["files"]))).alias("files_modified"), "ts")
    return told.where("tool_input_summary <> '' or tool_result_summary <> ''")
