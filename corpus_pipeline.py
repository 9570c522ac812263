"""Corpus preparation in stages: quality, near duplicates, repeated bytes, benchmarks, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next.
All but the last return the columns of documents; the last adds copy. In all stages other columns of docs are left behind, whatever
their names, an empty table gives an empty one, and a null doc_id, lang, source or n_chars comes through as it is.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, minhash_dedup, mixing, quality, suffix_dedup
from quarry.llm.scratch import land

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of docs, doesn't reject. A null text is scored as an empty one;
    repeated rows get one score and stay or go together."""
    net = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, net).where("quality_predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first, of each group of near duplicates: five-word shingles, similarity 0.8. Null and blank texts are near nothing;
    of rows repeated in full one stays."""
    return minhash_dedup.one_of_each(docs.select(*COLUMNS))


#: bytes of the strings that the stage of suffix arrays looks for: below the shortest passages of 51 words of ordinary prose
PASSAGE_BYTES = 250


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE_BYTES bytes that stand elsewhere already. One copy of each stays in the corpus, that of the
    smallest doc_id. Bytes of a character cut in two go, and so do documents with nothing left. Null and empty texts pass."""
    docs = docs.select(*COLUMNS).withColumn("none", F.col("text").isNull())
    params = suffix_dedup.ParseParams(width=PASSAGE_BYTES, keep_one=True)
    done = suffix_dedup.remove_repeated_bytes(docs, params, keep_text=True, carry=("lang", "source", "n_chars", "none"))
    done = done.where("n_removed = 0 or length(kept) > 0")
    text = F.when(~F.col("none"), F.col("kept"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, short ones too. Null and empty texts hold none; repeated rows stay or go together."""
    return decontaminate.without_benchmark(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"), decontaminate.GramParams(short=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's rate gives it, with the columns of documents and copy. A null source is one
    of the sources; rows of one doc_id are taken alike."""
    return mixing.emitted(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_bytes),
    ("benchmark decontamination", benchmark_filter),
    ("mixing sources", mix_sources),
]

#: Learnt and banded stages have no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
