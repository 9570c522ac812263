"""A resumable import: key ranges, each written and then committed with its counts, so that a run broken anywhere goes on."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.generations import exists, log, logged

#: a range of ids of one kind that is to be imported, in the order of `step`
PLAN = "gen int, kind string, step int, lo long, hi long"
#: what became of a range
DONE = "gen int, kind string, step int, lo long, hi long, seen long, migrated long, skipped long, errors long"

Transform = Callable[[DataFrame], DataFrame]


def _planned(rows: DataFrame, path: str, kind: str, batch: int, from_id: int) -> list:
    """The ranges of a kind: those planned before, and new ones for ids above them. Ids only grow, so nothing comes up below."""
    spark = rows.sparkSession
    have = [r for r in logged(spark, f"{path}/plan", PLAN) if r["kind"] == kind]
    above = max((r["hi"] for r in have), default=from_id - 1)
    left = rows.where(F.col("id") > above)
    n, top = left.agg(F.count("*"), F.max("id")).first()
    if n:
        parts = max(1, -(-n // batch))
        # quantiles cut the keys into ranges of about `batch` rows, as many as there are batches
        cuts = left.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
        edges = [above, *sorted(set(cuts) - {top}), top]
        first = max((r["step"] for r in have), default=-1) + 1
        ranges = [(first, kind, first + i, lo + 1, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]  # noqa: B905
        spark.createDataFrame(ranges, PLAN).coalesce(1).write.mode("append").parquet(f"{path}/plan/log")
        have += [r for r in logged(spark, f"{path}/plan", PLAN) if r["kind"] == kind and r["step"] >= first]
    return sorted({(r["step"], r["lo"], r["hi"]) for r in have})


def migrate(rows: DataFrame, path: str, kind: str, transform: Transform, batch: int = 100_000, limit: int | None = None, from_id: int = 0, dry_run: bool = False) -> DataFrame:
    """Import rows (id, ...; ids are whole numbers that only grow) of one kind into the folder `path`; returns progress().

    Ids are cut into ranges of about `batch` rows, which are written down first. Each range is read by its keys, transformed, written, and then
    committed by a row of counts; ranges that have theirs aren't read again. A run that broke left at most one range without a commit,
    which the next run writes anew, so nothing is lost or told twice. transform gives a row for each piece, with the id; an `error` that isn't null
    marks a row that couldn't be taken over: it's kept under errors, and the others go on. Ids that give no piece count as skipped. `limit` ends a
    run after so many ranges. A dry run writes nothing and returns (kind, left): how many rows are still to be read.
    """
    spark = rows.sparkSession
    told = [r for r in logged(spark, f"{path}/done", DONE) if r["kind"] == kind]
    if dry_run:
        left = rows.where(F.col("id") >= from_id)
        for r in told:
            left = left.where(~F.col("id").between(r["lo"], r["hi"]))
        return left.agg(F.lit(kind).alias("kind"), F.count("*").alias("left"))
    done = {r["step"] for r in told}
    left = [r for r in _planned(rows, path, kind, batch, from_id) if r[0] not in done]
    for step, lo, hi in left[:limit]:
        part = rows.where(F.col("id").between(lo, hi))
        at = f"{path}/data/kind={kind}/step={step}"
        _write(transform(part), at)
        _commit(spark, path, kind, step, lo, hi, part, at)
    return progress(spark, path)


def _write(pieces: DataFrame, at: str) -> None:
    pieces = pieces if "error" in pieces.columns else pieces.withColumn("error", F.lit(None).cast("string"))
    pieces.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(at)


def _commit(spark: SparkSession, path: str, kind: str, step: int, lo: int, hi: int, part: DataFrame, at: str) -> None:
    seen = part.count()
    got = spark.read.parquet(at).groupBy("id").agg(F.max(F.col("error").isNotNull()).alias("bad")) if _any(spark, at) else None
    told = got.agg(F.count(F.when(~F.col("bad"), 1)), F.count(F.when(F.col("bad"), 1))).first() if got is not None else (0, 0)
    log(spark, f"{path}/done", (step, kind, step, lo, hi, seen, told[0], seen - told[0] - told[1], told[1]), DONE)


def _any(spark: SparkSession, at: str) -> bool:
    return exists(spark, f"{at}/failed=false") or exists(spark, f"{at}/failed=true")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(kind, ranges, done, seen, migrated, skipped, errors) of an import."""
    plan = spark.createDataFrame([tuple(r) for r in logged(spark, f"{path}/plan", PLAN)], PLAN).select("kind", "step").distinct()
    done = spark.createDataFrame([tuple(r) for r in logged(spark, f"{path}/done", DONE)], DONE).drop("gen", "lo", "hi")
    j = plan.join(done, ["kind", "step"], "left")
    counts = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "migrated", "skipped", "errors"))
    return j.groupBy("kind").agg(F.count("*").alias("ranges"), F.count("seen").alias("done"), *counts)


def _of(spark: SparkSession, path: str, kind: str, failed: bool) -> DataFrame | None:
    steps = [r["step"] for r in logged(spark, f"{path}/done", DONE) if r["kind"] == kind]
    at = [f"{path}/data/kind={kind}/step={s}/failed={str(failed).lower()}" for s in steps]
    found = [a for a in at if exists(spark, a)]
    return spark.read.parquet(*found) if found else None


def migrated(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The pieces of committed ranges; None before there are any."""
    df = _of(spark, path, kind, False)
    return df.drop("error") if df is not None else None


def errors(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Rows of committed ranges that couldn't be taken over, with their error."""
    return _of(spark, path, kind, True)
