"""A stream of the lines that are appended to files: offsets are bytes of each file, so nothing is read twice.

    tail.register(spark)
    spark.readStream.format("line_tail").option("pattern", r"\\.jsonl$").load("/transcripts")
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "line_tail"
SCHEMA = "path string, at long, line string"
#: bytes of a file that one task reads; larger appends are several tasks' work
RANGE = 32 << 20
#: bytes of the first line that tell whether a file is still the same one
HEAD = 4096
_BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that begin within start..end; begins: whether a line begins at start for sure."""

    path: str
    start: int
    end: int
    begins: bool


def _last_line_end(f: pa.NativeFile, size: int) -> int:
    """The place after the last newline of the first `size` bytes, found from the end."""
    at = size
    while at:
        start = max(0, at - _BLOCK)
        f.seek(start)
        found = f.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


class LineTailReader(DataSourceStreamReader):
    """Offsets are {path: {"bytes": whole lines so far, "head": digest of the first line}}; files without a whole line have none.

    A file whose first line has changed, or that is shorter than what was read of it, is read from its beginning. A file that is gone is
    forgotten; what a failed batch had planned of it and is gone too is not there to be read again.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.pattern = options.get("pattern", "")
        self.range = int(options.get("rangeBytes", RANGE))

    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self._fs()
        out = {}
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.size or not re.search(self.pattern, info.path):
                continue
            try:
                with store.open_input_file(info.path) as f:
                    end = _last_line_end(f, info.size)
                    if end:
                        f.seek(0)
                        head = f.read(min(HEAD, end)).split(b"\n", 1)[0]
                        out[info.path] = {"bytes": end, "head": hashlib.sha256(head).hexdigest()[:16]}
            except FileNotFoundError:  # it went since it was listed
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in end.items():
            since = start.get(path)
            known = since is not None and since["head"] == to["head"] and since["bytes"] <= to["bytes"]
            at = since["bytes"] if known else 0
            out += [Range(path, i, min(i + self.range, to["bytes"]), i == at) for i in range(at, to["bytes"], self.range)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = self._fs()
        p = partition
        try:
            f = store.open_input_file(p.path)
        except FileNotFoundError:
            return
        with f:
            f.seek(p.start if p.begins else p.start - 1)
            at, rest, held = f.tell(), b"", []
            skip = not p.begins  # the line that is under way at start belongs to the range before

            def told() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array([p.path] * len(held), pa.string()), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1].decode("utf-8", "replace") for h in held], pa.string())], names=["path", "at", "line"])
                held.clear()
                return out

            while at < p.end:  # at: where the next line begins
                block = f.read(_BLOCK)
                if not block:
                    break
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < p.end:
                        held.append((at, line.removesuffix(b"\r")))
                    at += len(line) + 1
                if held:
                    yield told()

    def commit(self, end: dict) -> None:
        pass


class LineTail(DataSource):
    """(path, at, line): whole lines as they are appended to the files under a folder, with the byte at which each begins. Options: path (local or a URI that
    pyarrow reads), pattern (a regular expression that paths have to hold), rangeBytes. Bytes that aren't UTF-8 are replaced."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineTail)


def lines(spark: SparkSession, path: str, pattern: str = ""):
    """The stream of lines appended under path."""
    register(spark)
    return spark.readStream.format(NAME).option("pattern", pattern).load(path)
