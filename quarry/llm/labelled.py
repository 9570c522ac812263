"""Which labelled rows may be learnt from, and bounded samples of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fold that nothing is learnt from: crc32 of the id as text divides by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sampled_ids(labels: DataFrame, label: str, value: int, most: int) -> DataFrame:
    """At most `most` ids of rows outside the fold whose label has the value: those of the least hashes, so reruns agree."""
    rows = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The (doc_id, text) of sampled ids, with their other columns: they are few, their number being a parameter, so they go to every task."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
