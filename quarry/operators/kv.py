"""Keys and values as an append-only log (seq, key, value): the last row of a key holds, and a null value deletes it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame) -> DataFrame:
    """(key, value) of the keys that are set."""
    last = log.where("key is not null").groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    return last.select("key", "v.value").where("value is not null")


def beginning(key: Column, prefix: str) -> Column:
    """Whether a key begins with exactly this prefix: % and _ are characters like others."""
    return F.startswith(key, F.lit(prefix))


def listed(log: DataFrame, prefix: str) -> DataFrame:
    """(key, value) of the set keys with a prefix. Other keys aren't folded at all."""
    return current(log.where(beginning(F.col("key"), prefix)))


def compacted(log: DataFrame) -> DataFrame:
    """A log of what is set only, each key with its last seq."""
    last = log.where("key is not null").groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("value"), "seq").alias("v"))
    return last.select("seq", "key", "v.value").where("value is not null")
