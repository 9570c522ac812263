"""A stream of changes of files under a folder: added, changed, removed, by listings that are compared.

    watch.register(spark)
    spark.readStream.format("file_watch").option("pattern", r"\\.md$").load("/memory")
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "file_watch"
SCHEMA = "path string, change string, marker string"
#: changes that one task tells
_TOLD = 10_000


@dataclass
class Changes(InputPartition):
    rows: tuple[tuple[str, str, str | None], ...]


class WatchReader(DataSourceStreamReader):
    """Offsets are listings: {path: "size:mtime in ns"}. A file that came and went between two triggers isn't told; one that was written again is `changed`."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("pattern", "")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {i.path: f"{i.size}:{i.mtime_ns}" for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and re.search(self.pattern, i.path)}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        rows = [(p, "added" if p not in start else "changed", m) for p, m in end.items() if start.get(p) != m]
        rows += [(p, "removed", None) for p in start if p not in end]
        return [Changes(tuple(rows[i : i + _TOLD])) for i in range(0, len(rows), _TOLD)]

    def read(self, partition: Changes) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in partition.rows], pa.string()) for i in range(3)], names=["path", "change", "marker"])

    def commit(self, end: dict) -> None:
        pass


class FileWatch(DataSource):
    """(path, change, marker) of files under a folder as they come, change and go. Options: path (local or a URI that pyarrow reads), pattern."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WatchReader:
        return WatchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileWatch)
