"""Places to cut lineage: Parquet tables in the folder that the cluster shares."""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's. Where both are unset a new local one will do if Spark runs in this
    process alone, as in tests; on a cluster it's an error, as executors don't share it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        where = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete what this driver's operators wrote so far. Results that weren't written elsewhere can't be read after it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = threading.Lock(), {}


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """While any thread of the session is within, what Spark ran frees its shuffles; the last one out puts the setting back."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(key, (0, spark.conf.get(_FREE, None)))
        _writing[key] = n + 1, before
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            elif before is None:
                spark.conf.unset(_FREE)
            else:
                spark.conf.set(_FREE, before)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a reader of what was written: later jobs don't repeat its work, and lost executors can't lose it.

    The shuffles that df took aren't needed any more, so their disk is freed at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    with freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
