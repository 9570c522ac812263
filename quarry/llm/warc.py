"""WARC archives: written by partition, indexed record by record, and read back by coalesced byte ranges."""

import gzip
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import land, new_path


class WarcParams(NamedTuple):
    #: payloads of so many bytes and more are stored once
    revisit_bytes: int = 1000
    #: a range read goes over gaps of so many bytes, and has so many at most unless one record has more
    gap: int = 1 << 16
    most: int = 8 << 20
    #: bytes of records that a task reads back
    task_bytes: int = 64 << 20


INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _member(lines: list[str], block: bytes) -> bytes:
    return gzip.compress("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


_DATE = "WARC-Date: 1970-01-01T00:00:00Z"


def _info(file: str) -> bytes:
    return _member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{file}>", _DATE, f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def _record(r: dict) -> bytes:
    """One gzip member holding a WARC/1.1 record; all its lines come from the row, so that a repeated task writes the same.
    A record is named by its page and payload, so names are repeated only if rows are."""
    revisit = r["refers_to"] is not None
    clean = lambda s: " ".join((s or "").split())
    page = "" if r["page_id"] is None else str(r["page_id"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}:{r['digest']}>",
        _DATE,
        f"WARC-Target-URI: {clean(r['url'])}",
        f"WARC-Payload-Digest: sha1:{r['digest']}",
        f"X-Payload-Length: {r['size']}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r['refers_to']}:{r['digest']}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
    return _member(lines, http if revisit else http + r["payload"])


def parse_record(raw: bytes) -> dict:
    """The headers of one gzip member, by lower-case name, and as body its block, of HTTP the payload."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers | {"body": block.partition(b"\r\n\r\n")[2] if headers["content-type"].startswith("application/http") else block}


def _writer(where: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                    offset = out.write(_info(file))
                raw = _record(r)
                out.write(raw)
                index.append({"file": file, "offset": offset, "length": len(raw), "url": r["url"], "digest": r["digest"], "record_type": "response" if r["refers_to"] is None else "revisit", "page_id": r["page_id"]})
                offset += len(raw)
            yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        if out is not None:
            out.close()

    return run


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())])
_RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def write_archives(pages: DataFrame, params: WarcParams = WarcParams()) -> tuple[str, DataFrame]:
    """Write a record per row of pages (page_id, url, html): (folder in the shared store, index).

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of revisit_bytes or more, those of the
    largest page_id are responses and the others revisits of it; where none has a page_id, all are responses.
    Smaller payloads are responses. A null url is written as an empty one, white space in it as single spaces.

    Rows repeated in full are records each, of one name; rows of one page_id are told apart by their payloads. Other columns are ignored, and
    an empty table gives an empty index. A payload has to fit in a task.

    Each task writes one file and tells where each record is; files of failed or repeated tasks are in no index.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # only digests that occur again meet their pages: a few light rows, whose hot digests AQE splits
    again = rows.select("digest", "size", "page_id").where(F.col("size") >= params.revisit_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).where("n > 1").drop("n")
    rows = rows.join(again, ["digest", "size"], "left")
    rows = rows.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull()), F.col("original")))
    where = new_path(pages.sparkSession, "warc")
    where = where if "://" in where or where.startswith("file:") else f"file://{where}"
    index = rows.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(_writer(where), INDEX)
    return where, land(index, "warc-index")


def _reader(where: str, params: WarcParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        name, source = None, None
        for batch in batches:
            wanted, i, out, size = batch.to_pylist(), 0, [], 0
            while i < len(wanted):
                first, j, end = wanted[i], i + 1, wanted[i]["offset"] + wanted[i]["length"]
                while j < len(wanted) and wanted[j]["file"] == first["file"] and wanted[j]["offset"] - end <= params.gap and wanted[j]["offset"] + wanted[j]["length"] - first["offset"] <= params.most:
                    end = max(end, wanted[j]["offset"] + wanted[j]["length"])
                    j += 1
                if first["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = first["file"], store.open_input_file(f"{root}/{first['file']}")
                block = source.read_at(end - first["offset"], first["offset"])
                for w in wanted[i:j]:
                    at = w["offset"] - first["offset"]
                    h = parse_record(block[at : at + w["length"]])
                    page, refers = h["warc-record-id"].split(":")[2], h.get("warc-refers-to")
                    out.append({"file": w["file"], "offset": w["offset"], "page_id": int(page) if page else None, "url": h["warc-target-uri"], "record_type": h["warc-type"], "refers_to": int(refers.split(":")[2]) if refers else None, "payload_bytes": int(h["x-payload-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "payload": None if refers else h["body"]})
                    size += len(h["body"])
                if size >= params.most:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                    out, size = [], 0
                i = j
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
        if source is not None:
            source.close()

    return run


def read_records(where: str, index: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """The records that index selects (any rows of a folder's index), as RECORD. Rows go by file and place, so that
    neighbours are read by one range read, and as many tasks as the records' bytes ask for, one for each core at least. A revisit has
    its payload's length and digest, and a null payload; an empty index gives no records."""
    wanted = index.select("file", "offset", "length")
    size = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // params.task_bytes), wanted.sparkSession.sparkContext.defaultParallelism)
    wanted = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_reader(where, params), RECORD)


def verified(records: DataFrame) -> DataFrame:
    """records with payload digest and length taken from the payload itself where there is one; no records give none."""
    own = F.col("payload").isNotNull()
    return records.withColumn("payload_bytes", F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))).withColumn("payload_digest", F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN original IS NOT NULL AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""
