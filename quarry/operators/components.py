"""Connected components by contraction, for edge tables of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scratch import land


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), in either direction, repeats and loops allowed. Returns (id, component) for every
    node of an edge that is no loop; component is the smallest id that can be reached.

    Each round points every node at its smallest neighbour, follows pointers twice and keeps one edge between
    what they lead to. A path of n nodes takes about log4 n rounds. Rounds are written to shared storage.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, labels = land(e, "edges"), None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        p = land(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "parents")
        for _ in range(2):
            up = p.select(F.col("id").alias("p"), F.col("p").alias("up"))
            p = p.join(up, "p").select("id", F.col("up").alias("p"))
        p = land(p, "parents")
        to = [p.select(F.col("id").alias(x), F.col("p").alias(f"p{x}")) for x in "ab"]
        e = e.join(to[0], "a").join(to[1], "b").where("pa <> pb")
        e = land(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        step = p.select(F.col("id").alias("component"), F.col("p").alias("up"))
        labels = p.select("id", F.col("p").alias("component")) if labels is None else labels.join(step, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where(F.lit(False))
    return labels
