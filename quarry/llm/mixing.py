"""Mixing sources to target weights: repetition rates per source, then whole and hash-seeded copies."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import land


class MixParams(NamedTuple):
    #: weights of the sources in code point order, null last, used again from the first when they run out
    weights: tuple[int, ...] = (1, 2, 3)
    #: the mix holds this share of all words, and a source at most so many times its own
    total: float = 1.0
    most: int = 3
    seed: str = "mix-0"
    #: sources up to which their table goes to every task; more are joined by a shuffle
    broadcast_sources: int = 20_000


WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(source, source_size, target, rate) of each source of sizes (source, size).

    Targets are shares of `total` of all words by weight. A target stops at `most` times its source's
    size, and what is above goes to the others by weight: with sources in order of size over weight, the
    level (words a unit of weight) is the highest of those reached by filling all before and sharing the rest.
    The windows run over one row for each source.
    """
    p = params
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), (place % len(p.weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * p.most)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(everything).cast("double") * F.lit(float(p.total))
    per = per.withColumn("level", (all_words - before.cast("double")) / rest.cast("double"))
    per = per.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies and taken (copies * size).

    Each document is due floor(rate) copies and one more if a hash of its id, as a fraction, is below the
    rate's fraction; so reruns agree and rows of one id are treated alike. A null or empty text has size 0; a
    null source is a source; a null doc_id hashes as an empty string. Columns of these names are replaced. An empty table gives an
    empty result; texts may be of any length, as words are only counted.
    """
    p = params
    docs = docs.drop("size", "source_size", "target", "copies", "taken").withColumn("size", words_in())
    per = land(source_targets(docs.select("source", "size"), p), "sources")
    small = per.limit(p.broadcast_sources + 1).count() <= p.broadcast_sources
    per = per.withColumnRenamed("source", "of")
    fraction = F.conv(F.substring(F.md5(F.concat(F.lit(p.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    copies = F.floor("rate") + F.when(fraction < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    joined = docs.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("of", "rate")


def emitted(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: each document as often as it is due, with all its columns and copy, from 0."""
    cols = [c for c in docs.columns if c != "copy"]
    due = mixed(docs.select(*cols), params).where("copies > 0")
    return due.select(*cols, F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM per
), filled AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM filled) * weight::DOUBLE) AS target FROM filled
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
"""
