"""Judges behind a kept table of answers: by content, so that what was asked once is never asked again."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import context
from quarry.operators.generations import log, logged
from quarry.operators.scratch import land

LOG = "gen int, answers long"
ANSWER = "key string, reply string"

#: replies of a judge to prompts; None, or an error, is no answer
Judge = Callable[[list[str]], list[str | None]]


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, reply) of all that was answered."""
    gens = [r["gen"] for r in logged(spark, path, LOG)]
    return spark.read.schema(ANSWER).parquet(*[f"{path}/answers/gen={g}" for g in gens]) if gens else spark.createDataFrame([], ANSWER)


def _asked(judge: Judge, tries: int, at_once: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), at_once):
                part = pdf.iloc[i : i + at_once]
                prompts, replies = part["prompt"].tolist(), [None] * len(part)
                for _ in range(tries):
                    left = [k for k, r in enumerate(replies) if r is None]
                    if not left:
                        break
                    try:
                        got = judge([prompts[k] for k in left])
                    except Exception:  # noqa: BLE001  a judge may fail in any way; its rows are tried again, now or in the next run
                        continue
                    for k, r in zip(left, got, strict=True):
                        replies[k] = r
                yield pd.DataFrame({"key": part["key"].tolist(), "reply": replies})

    return run


def judged(items: DataFrame, key: Column, prompt: Column, judge: Judge, path: str, tries: int = 3, at_once: int = 16, in_task: int = 1000) -> DataFrame:
    """items with `reply`: from the answers kept at path, and where there is none from the judge, who is asked once for each distinct key.

    key says what an answer depends on (by a digest of its text); rows of a null key get no reply. The judge runs in tasks on lists of up to `at_once`
    prompts; of a list only rows without a reply are tried again, up to `tries` times. What is answered is kept before anything else is done with it,
    so a later run asks for the rest only. One run at a time writes to a path.
    """
    spark = items.sparkSession
    rows = items.withColumn("judge_key", F.sha2(key.cast("string"), 256))
    todo = rows.where("judge_key is not null").select(F.col("judge_key").alias("key"), prompt.alias("prompt")).groupBy("key").agg(F.min("prompt").alias("prompt"))
    todo = land(todo.join(answers(spark, path), "key", "left_anti"), "prompts")
    n = todo.count()
    if n:
        gen = max((r["gen"] for r in logged(spark, path, LOG)), default=-1) + 1
        new = todo.repartition(-(-n // in_task)).mapInPandas(_asked(judge, tries, at_once), ANSWER).where("reply is not null")
        new.write.mode("overwrite").parquet(f"{path}/answers/gen={gen}")
        log(spark, path, (gen, spark.read.schema(ANSWER).parquet(f"{path}/answers/gen={gen}").count()), LOG)
    known = answers(spark, path).dropDuplicates(["key"]).withColumnRenamed("key", "judge_key")
    return rows.join(known, "judge_key", "left").drop("judge_key")


GRADING = "You grade how well a document answers a search query. Reply with one digit only: 0 (irrelevant), 1 (slightly), 2 (relevant), 3 (a perfect answer)."


def graded(pairs: DataFrame, judge: Judge, path: str, shown: int = 2000) -> DataFrame:
    """pairs (query, text, ...) with the judge's grade, 0 to 3; null where there was no answer. The judge sees the first `shown` characters of a text,
    the key is of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    prompt = F.concat_ws("\n", F.lit(GRADING), F.concat(F.lit("Query: "), F.col("query")), F.lit("Document:"), F.substring(text, 1, shown))
    told = judged(pairs, F.concat_ws("\x1f", F.length("query").cast("string"), F.col("query"), text), prompt, judge, path)
    return told.withColumn("grade", F.when(F.col("reply").isNotNull(), context.grade(F.col("reply")))).drop("reply")
