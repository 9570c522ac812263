"""Vector expressions in double precision, over arrays of numbers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity_of_distance(d: Column) -> Column:
    """Cosine from the distance of unit vectors, moved to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 4))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): component means, summed where the rows are."""
    parts = df.select(key, F.posexplode(_double(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))
