"""A kept vector index: files by collection and cluster, appended to, split and merged without touching other clusters.

The index is a folder of generations. Each change writes vectors under `gen=<n>/collection=<c>/cluster_id=<i>`, then the catalog of clusters, and
last a row of the log; readers use generations and clusters that the last row names. A cluster whose rows change is written again under a new number,
so folders are never rewritten in place, all others keep their files, and a change that broke is as if it hadn't been. Clusters below 0 have
no centroid and are always searched: those of collections that are too small for an index.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import vector as V
from quarry.operators import nearest as N
from quarry.operators.generations import log, logged
from quarry.operators.scratch import land
from quarry.operators.search import BLOCK, _top, in_blocks


@dataclass(frozen=True)
class Sizes:
    per_cluster: int = 300
    #: vectors of a collection below which it isn't clustered
    least: int = 3000
    #: clusters of all collections together, about; bounds what goes to every task (8 MB at 64 numbers each)
    most: int = 16_384
    rounds: int = 3
    #: clusters of more than so many times per_cluster are split, of less are merged into others
    split: float = 2.0
    merge: float = 0.25
    #: generations over which a cluster may lie before it is put together
    spread: int = 8


#: vectors of one cluster above which several tasks write them
LARGE = 20_000
LOG = "gen int, dim int, per_cluster int, least int, id_type string, gens array<int>"


@dataclass(frozen=True)
class Catalog:
    """Clusters in use: numbers, collections, centroids (NaN: none) and vectors told so far. Bounded by Sizes.most."""

    number: np.ndarray
    collection: np.ndarray
    centroid: np.ndarray
    hits: np.ndarray

    def where(self, mask: np.ndarray) -> "Catalog":
        return Catalog(self.number[mask], self.collection[mask], self.centroid[mask], self.hits[mask])

    def __add__(self, other: "Catalog") -> "Catalog":
        return Catalog(*(np.concatenate(x) for x in zip(vars(self).values(), vars(other).values(), strict=True)))


def _head(spark: SparkSession, path: str) -> dict | None:
    rows = logged(spark, path, LOG)
    return rows[-1].asDict() if rows else None


CATALOG = "cluster_id int, collection string, centroid array<double>, hits long"


def catalog(spark: SparkSession, path: str) -> Catalog:
    head = _head(spark, path)
    rows = spark.read.schema(CATALOG).parquet(f"{path}/catalog/gen={head['gen']}").toArrow()
    centroid = np.full((rows.num_rows, head["dim"]), np.nan)
    for at, x in N.by_length(rows["centroid"].combine_chunks()):
        centroid[at] = x
    return Catalog(rows["cluster_id"].to_numpy().astype(np.int64), np.array(rows["collection"].to_pylist(), object), centroid, rows["hits"].to_numpy().astype(np.int64))


def _loose(rows: list[tuple], dim: int) -> Catalog:
    """Clusters (number, collection, vectors) without a centroid."""
    return Catalog(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], object), np.full((len(rows), dim), np.nan), np.array([r[2] for r in rows], np.int64))


_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders of clusters are listed by a few tasks for each core, not by a task each."""
    before = spark.conf.get(_LISTERS, None)
    spark.conf.set(_LISTERS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_LISTERS) if before is None else spark.conf.set(_LISTERS, before)


def _read(spark: SparkSession, path: str, gens: list[int], columns: str) -> DataFrame:
    rows = spark.read.schema(f"{columns}gen int, collection string, cluster_id int").option("basePath", f"{path}/vectors")
    with _listing(spark):
        rows = rows.parquet(*([f"{path}/vectors/gen={g}" for g in gens] or [f"{path}/vectors"]))
    return rows.where(F.col("gen").isin(*(gens or [-1])))


def _within(column: str, numbers: np.ndarray) -> Column:
    """Whether a column is one of the numbers; a list of many goes to the JVM as one text."""
    return F.expr(f"{column} in ({','.join(map(str, numbers.tolist()))})") if len(numbers) else F.lit(False)


def vectors_of(spark: SparkSession, path: str, clusters: Catalog | None = None) -> DataFrame:
    """(id, vector, gen, collection, cluster_id) of the index, or of some of its clusters: their folders only are read.

    Clusters are small files, of which a task reads many."""
    head = _head(spark, path)
    clusters = catalog(spark, path) if clusters is None else clusters
    rows = _read(spark, path, list(head["gens"] or []), f"id {head['id_type']}, vector array<float>, ")
    return rows.where(_within("cluster_id", clusters.number)).coalesce(4 * spark.sparkContext.defaultParallelism)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(shared, dim: int, sums: bool):
    """The number of the nearest centroid of each row's scope by cosine, ties to the lower number; -1 where a scope has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of, centroid = shared.value
        order, own = np.argsort(number, kind="stable"), {}
        for i in order.tolist():
            own.setdefault(of[i], []).append(i)
        total, n = (np.zeros((len(number) + 1, dim)), np.zeros(len(number) + 1, np.int64)) if sums else (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, scope = _matrix(batch["vector"], dim), batch["scope"].dictionary_encode()
            at, told = np.full(len(x), -1, np.int64), scope.indices.to_numpy()
            for i, s in enumerate(scope.dictionary.to_pylist()):
                if s in own:
                    rows, mine = np.flatnonzero(told == i), np.array(own[s])
                    at[rows] = mine[N.closest(x[rows], centroid[mine])]
            if sums:
                np.add.at(total, at, x)
                np.add.at(n, at, 1)
            else:
                c = pa.array(np.where(at < 0, -1, number[at] if len(number) else -1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch[m] for m in ("id", "vector", "collection", "scope")), c], names=["id", "vector", "collection", "scope", "cluster_id"])
        if sums:
            seen = np.flatnonzero(n[:-1])
            for i in range(0, len(seen), 256):
                part = seen[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(number[part]), pa.array(list(total[part]), pa.list_(pa.float64())), pa.array(n[part])], names=["cluster_id", "total", "n"])

    return run


def _assigned(rows: DataFrame, clusters: tuple[np.ndarray, np.ndarray, np.ndarray], dim: int) -> DataFrame:
    """rows (id, vector, collection, scope) with the nearest cluster of their scope."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(clusters)
    return rows.mapInArrow(_assign(shared, dim, False), f"id {kind}, vector array<float>, collection string, scope string, cluster_id int")


def _trained(rows: DataFrame, counts: dict[str, int], first: int, dim: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, scopes, centroids, hits): counts[scope] clusters for each scope of rows (id, vector, scope), numbered from `first`.

    Seeds are the vectors of least hash; each round moves centroids by the mini-batch rule. Tasks send a sum for each cluster.
    """
    spark = rows.sparkSession
    want = spark.createDataFrame([(s, k) for s, k in counts.items()], "scope string, k int")
    ranked = _by_scope(rows.join(F.broadcast(want), "scope"), F.xxhash64("id"))
    picked = ranked.select("scope", "rank", "vector").toArrow().sort_by([("scope", "ascending"), ("rank", "ascending")]).combine_chunks()  # one for each cluster
    number = np.arange(first, first + picked.num_rows)
    of = np.array(picked["scope"].to_pylist(), object)
    centroid = _matrix(picked["vector"].combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    hits = np.ones(picked.num_rows, np.int64)
    for _ in range(rounds if picked.num_rows else 0):
        shared = spark.sparkContext.broadcast((number, of, centroid))
        sums = rows.select("vector", "scope").mapInArrow(_assign(shared, dim, True), "cluster_id long, total array<double>, n long")
        part = sums.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dim))).alias("total"))
        got = part.toArrow()
        i, n = got["cluster_id"].to_numpy() - first, got["n"].to_numpy()
        rate = np.maximum(0.01, n / (hits[i] + n))[:, None]
        centroid[i] += rate * (_matrix(got["total"].combine_chunks(), dim) / n[:, None] - centroid[i]) if len(i) else 0
        hits[i] += n
    return number, of, centroid, hits


def _by_scope(rows: DataFrame, order: Column) -> DataFrame:
    """The first k rows of each scope, with rank."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(order, "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))


def _checked(vectors: DataFrame, dim: int | None) -> tuple[DataFrame, int]:
    """vectors as (id, vector, collection), which must all have `dim` finite numbers (None: as many as the first) and an id of their own."""
    collection = F.coalesce(F.col("collection").cast("string"), F.lit("default")) if "collection" in vectors.columns else F.lit("default")
    rows = vectors.select("id", F.col("vector").cast("array<float>").alias("vector"), collection.alias("collection"))
    if dim is None:
        first = rows.where("vector is not null").first()
        dim = len(first["vector"]) if first else 0
    whole = F.size("vector") == dim
    fine = F.coalesce(whole & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.col("id").isNotNull()
    bad = rows.where(~fine).select("id", F.size("vector").alias("n")).first()
    if bad:
        raise ValueError(f"vector of {bad['id']} has {bad['n']} numbers or some that aren't finite; {dim} are expected")
    return rows, dim


def _commit(spark: SparkSession, path: str, gen: int, rows: DataFrame | None, clusters: Catalog, head: dict) -> None:
    """Write rows (id, vector, collection, cluster_id) as a generation, then the catalog, then the log."""
    gens = list(head["gens"] or [])
    if rows is not None:
        # a cluster is one file; only one that is large for a task is several tasks' work
        rows = land(rows.select("id", "vector", "collection", "cluster_id"), "placed")
        large = rows.groupBy("cluster_id").count().where(F.col("count") > LARGE).collect()  # at most as many as there are clusters, and few as a rule
        part = F.when(_within("cluster_id", np.array([r["cluster_id"] for r in large])), F.pmod(F.xxhash64("id"), F.lit(8))).otherwise(0)
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cluster_id", part)
        dealt.write.mode("overwrite").partitionBy("collection", "cluster_id").parquet(f"{path}/vectors/gen={gen}")
        gens.append(gen)
    none = np.isnan(clusters.centroid).any(axis=1)
    centroid = pa.array([None if gone else v for gone, v in zip(none.tolist(), clusters.centroid, strict=True)], pa.list_(pa.float64()))
    listed = pa.table({"cluster_id": pa.array(clusters.number, pa.int32()), "collection": pa.array(clusters.collection, pa.string()), "centroid": centroid, "hits": pa.array(clusters.hits, pa.int64())})
    (spark.createDataFrame(listed) if len(none) else spark.createDataFrame([], CATALOG)).coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog/gen={gen}")
    log(spark, path, (gen, head["dim"], head["per_cluster"], head["least"], head["id_type"], gens), LOG)


def _clustered(rows: DataFrame, names: list[str], sizes: dict[str, int], head: dict, first: int, lowest: int, rounds: int) -> tuple[DataFrame, Catalog]:
    """Give rows (id, vector, collection) of new collections clusters: of those below head['least'] vectors one without a centroid."""
    dim = head["dim"]
    counts = {c: max(1, round(sizes[c] / head["per_cluster"])) for c in names if sizes[c] >= head["least"]}
    rows = rows.withColumn("scope", F.col("collection"))
    number, of, centroid, hits = _trained(rows, counts, first, dim, rounds)
    loose = [c for c in names if c not in counts]
    plain = _loose([(lowest - 1 - i, c, sizes[c]) for i, c in enumerate(loose)], dim)
    done = _assigned(rows, (number, of, centroid), dim)
    loose_ids = rows.sparkSession.createDataFrame([(c, int(n)) for c, n in zip(plain.collection, plain.number, strict=True)], "collection string, own int")
    done = done.join(F.broadcast(loose_ids), "collection", "left").withColumn("cluster_id", F.coalesce("own", "cluster_id")).drop("own")
    return done, Catalog(number, of, centroid, hits) + plain


def create(vectors: DataFrame, path: str, sizes: Sizes = Sizes()) -> None:
    """Write an index of vectors (id, vector, and collection if there are several; ids are distinct). All vectors have one length and finite numbers, else it
    is an error. Each collection has centroids of its own; a null collection is `default`."""
    spark = vectors.sparkSession
    rows, dim = _checked(vectors, None)
    each = {r["collection"]: r["count"] for r in rows.groupBy("collection").count().collect()}  # a row for each collection
    n = sum(each.values())
    head = {"dim": dim, "per_cluster": max(sizes.per_cluster, -(-n // sizes.most)), "least": max(sizes.least, -(-n // sizes.most)), "id_type": vectors.schema["id"].dataType.simpleString(), "gens": []}
    done, clusters = _clustered(rows, sorted(each), each, head, 0, 0, sizes.rounds)
    _commit(spark, path, 0, done, clusters, head)


def append(vectors: DataFrame, path: str, sizes: Sizes = Sizes()) -> None:
    """Add vectors (id, vector, collection), each to the nearest cluster of its collection; one whose id the index has takes that one's place.

    Vectors of another length than the index's are an error, and nothing is written. Only clusters that lose a replaced vector are written again.
    """
    spark = vectors.sparkSession
    head, clusters = _head(spark, path), catalog(spark, path)
    rows, dim = _checked(vectors, head["dim"] or None)  # 0: the index was built of no vectors
    rows, head = land(rows, "vectors"), head | {"dim": dim}
    if not dim:
        return
    if not len(clusters.number):
        clusters = _loose([], dim)
    have = vectors_of(spark, path)
    hit = [r["cluster_id"] for r in have.select("id", "cluster_id").join(rows.select("id"), "id", "left_semi").select("cluster_id").distinct().collect()]  # clusters at most
    each = {r["collection"]: r["count"] for r in rows.groupBy("collection").count().collect()}
    known = set(clusters.collection)
    first, lowest = int(clusters.number.max(initial=-1)) + 1, int(clusters.number.min(initial=0))
    parts = []
    if hit:  # the same clusters under new numbers, without what is replaced
        mask = np.isin(clusters.number, hit)
        old, clusters = clusters.where(mask), clusters.where(~mask)
        loose = old.number < 0
        number = np.empty(len(old.number), np.int64)
        number[~loose] = np.arange(first, first + (~loose).sum())
        number[loose] = lowest - 1 - np.arange(loose.sum())
        first, lowest = first + int((~loose).sum()), lowest - int(loose.sum())
        names = spark.createDataFrame(list(zip(old.number.tolist(), number.tolist(), strict=True)), "cluster_id int, new int")
        stay = vectors_of(spark, path, old).join(rows.select("id"), "id", "left_anti").join(F.broadcast(names), "cluster_id")
        parts.append(stay.select("id", "vector", "collection", F.col("new").alias("cluster_id")))
        clusters = clusters + Catalog(number, old.collection, old.centroid, old.hits)
    if new := sorted(c for c in each if c not in known):
        done, more = _clustered(rows.where(F.col("collection").isin(*new)), new, each, head, first, lowest, sizes.rounds)
        parts.append(done.select("id", "vector", "collection", "cluster_id"))
        clusters = clusters + more
    with_, plain = clusters.where(clusters.number >= 0), clusters.where(clusters.number < 0)
    kept_ = rows.where(F.col("collection").isin(*known)) if known else rows.limit(0)
    placed = _assigned(kept_.withColumn("scope", F.col("collection")), (with_.number, with_.collection, with_.centroid), dim)
    loose_ids = spark.createDataFrame(list(zip(plain.collection.tolist(), plain.number.tolist(), strict=True)), "collection string, own int").groupBy("collection").agg(F.min("own").alias("own"))
    placed = placed.join(F.broadcast(loose_ids), "collection", "left").withColumn("cluster_id", F.when(F.col("cluster_id") < 0, F.col("own")).otherwise(F.col("cluster_id")))
    parts.append(placed.select("id", "vector", "collection", "cluster_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    _commit(spark, path, head["gen"] + 1, out, clusters, head)


def rebalance(spark: SparkSession, path: str, sizes: Sizes = Sizes()) -> dict[str, list[int]]:
    """One round of upkeep: split clusters that have grown too large, dissolve starved ones into their neighbours, cluster collections that have reached
    `least`, and put clusters together that lie over many generations. Returns the numbers of clusters `split`, `merged` and `packed`; the
    folders of all others aren't touched."""
    head, clusters = _head(spark, path), catalog(spark, path)
    dim, per = head["dim"], head["per_cluster"]
    seen = vectors_of(spark, path).groupBy("cluster_id").agg(F.count("*").alias("n"), F.collect_set("gen").alias("gens")).collect()  # a row for each cluster
    n, gens = {r["cluster_id"]: r["n"] for r in seen}, {r["cluster_id"]: len(r["gens"]) for r in seen}
    head["gens"] = sorted({g for r in seen for g in r["gens"]})  # others hold clusters that aren't in use any more
    size = np.array([n.get(c, 0) for c in clusters.number.tolist()])
    plain = clusters.number < 0
    large = np.where(plain, size >= head["least"], size > sizes.split * per)
    starved = ~plain & (size < sizes.merge * per)
    for c in np.unique(clusters.collection.astype(str)):  # the largest of a collection stays, so that there is somewhere to go
        own = np.flatnonzero((clusters.collection == c) & ~plain)
        if len(own) and starved[own].all():
            starved[own[size[own].argmax()]] = False
    packed = ~large & ~starved & (np.array([gens.get(c, 0) for c in clusters.number.tolist()]) > sizes.spread)
    told = {"split": clusters.number[large].tolist(), "merged": clusters.number[starved].tolist(), "packed": clusters.number[packed].tolist()}
    if not (large | starved | packed).any():
        return told
    first, lowest = int(clusters.number.max(initial=-1)) + 1, int(clusters.number.min(initial=0))
    left, parts = clusters.where(~(large | starved | packed)), []
    if large.any():
        old = clusters.where(large)
        rows = vectors_of(spark, path, old).withColumn("scope", F.col("cluster_id").cast("string"))
        counts = {str(c): max(2, round(n[c] / per)) for c in old.number.tolist()}
        number, of, centroid, hits = _trained(rows, counts, first, dim, sizes.rounds)
        parts.append(_assigned(rows.select("id", "vector", "collection", "scope"), (number, of, centroid), dim))
        home = dict(zip(map(str, old.number.tolist()), old.collection, strict=True))
        left = left + Catalog(number, np.array([home[s] for s in of], object), centroid, hits)
        first += len(number)
    if packed.any():
        old = clusters.where(packed)
        loose = old.number < 0
        number = np.where(loose, lowest - 1 - (np.cumsum(loose) - 1), first + np.cumsum(~loose) - 1)
        names = spark.createDataFrame(list(zip(old.number.tolist(), number.tolist(), strict=True)), "cluster_id int, new int")
        parts.append(vectors_of(spark, path, old).join(F.broadcast(names), "cluster_id").drop("cluster_id").withColumnRenamed("new", "cluster_id"))
        left = left + Catalog(number, old.collection, old.centroid, old.hits)
    if starved.any():
        with_ = left.where(left.number >= 0)
        rows = vectors_of(spark, path, clusters.where(starved)).withColumn("scope", F.col("collection"))
        parts.append(_assigned(rows.select("id", "vector", "collection", "scope"), (with_.number, with_.collection, with_.centroid), dim))
    out = None
    for p in parts:
        p = p.select("id", "vector", "collection", "cluster_id")
        out = p if out is None else out.unionByName(p)
    _commit(spark, path, head["gen"] + 1, out, left, head)
    return told


def _asks(clusters: Catalog, ids: pa.Array, points: np.ndarray, of: list, probes: int) -> N.Asked:
    """Which clusters the points of collections `of` (None for all of them: all collections) are to be looked for in."""
    asked, place, own, plain = N.Asked(ids, list(points)), [], [], clusters.number < 0
    for c in sorted(set(of), key=str):
        at, fits = np.array([i for i, o in enumerate(of) if o == c], np.int64), clusters.collection == c if c is not None else np.ones(len(plain), bool)
        asked.tell(clusters.number[fits & plain], at)
        near = np.flatnonzero(fits & ~plain)
        near = near[np.argsort(clusters.number[near])]
        if probes >= len(near):
            asked.tell(clusters.number[near], at)
        else:
            r, j = N.leading(np.nan_to_num(points[at]), clusters.centroid[near], probes)
            place.append(at[r])
            own.append(clusters.number[near[j]])
    if place:
        asked.tell_pairs(np.concatenate(place), np.concatenate(own))
    return asked


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 16) -> DataFrame:
    """(query_id, id, rank, distance, score): the k nearest by L2 within each query's `probes` nearest clusters (by cosine) and all clusters without a centroid.

    queries: query_id, vector, and collection, if only one is to be searched (null: all). Queries go in blocks. One block reads the folders of its
    clusters only; for more the vectors are read once and written together. A query without a vector or with one of another length finds nothing.
    """
    head, clusters = _head(spark, path), catalog(spark, path)
    dim = head["dim"]
    scoped = "collection" in queries.columns
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where(F.size("vector") == dim).select("query_id", "vector", *(["collection"] if scoped else []))
    # what each query asks for is told to every task, unless it is all that there is
    most = BLOCK if probes >= (clusters.number >= 0).sum() else max(1, min(BLOCK, N.CELLS // max(1, probes)))
    blocks = [b.where(c) for c in (["collection is null", "collection is not null"] if scoped else ["true"]) for b in in_blocks(asked.where(c), "query_id", most)]
    found, rows = None, None
    for i, block in enumerate(blocks):
        got = block.toArrow()  # as many rows as a block has
        if not got.num_rows and (found is not None or i + 1 < len(blocks)):
            continue
        points = np.array(got["vector"].to_pylist(), np.float64).reshape(got.num_rows, dim)
        told = _asks(clusters, got["query_id"].combine_chunks(), points, got["collection"].to_pylist() if scoped else [None] * len(points), probes).done()
        if len(blocks) > 2:
            rows = land(vectors_of(spark, path).select("id", "vector", "cluster_id"), "vectors") if rows is None else rows
        else:
            rows = vectors_of(spark, path, clusters.where(np.isin(clusters.number, told[2]))).select("id", "vector", "cluster_id")
        pairs = rows.mapInArrow(N.probing(spark.sparkContext.broadcast(told), k), f"query_id {kind}, id {head['id_type']}, distance double")
        found = pairs if found is None else found.unionByName(pairs)
    return _top(found, k, F.round("distance", 9), F.col("id")).select("query_id", "id", "rank", "distance", V.similarity_of_distance(F.col("distance")).alias("score"))


def stale(spark: SparkSession, path: str) -> list[str]:
    """Folders of clusters that aren't in use any more; they can be deleted when no search that began before runs."""
    used, gens = catalog(spark, path).number, {g for r in logged(spark, path, LOG) for g in r["gens"] or []}
    gone = _read(spark, path, sorted(gens), "").where(~_within("cluster_id", used)).select("gen", "collection", "cluster_id").distinct().collect()
    return sorted(f"{path}/vectors/gen={r['gen']}/collection={r['collection']}/cluster_id={r['cluster_id']}" for r in gone)

