"""Embedding near-dedup: randomised-rotation binary codes with correction factors, and exact cosines where bounds ask for them."""

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.components import connected_components
from quarry.llm.scratch import land


class CodeParams(NamedTuple):
    cosine: float = 0.95
    #: vectors in a bucket agree in this many bits of a rotation's code; a pair at cosine 0.95 shares
    #: no bucket with probability (1 - 0.1816)**bands, 6e-5 here
    band_bits: int = 16
    bands: int = 48
    #: bits that go with a vector into its buckets, and standard deviations that its bounds allow for
    check_bits: int = 256
    sigmas: float = 5.0
    #: vectors compared in one task; larger buckets and groups are compared in pairs of chunks
    chunk: int = 512
    seed: int = 1


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signs(u: np.ndarray, bits: int, p: CodeParams) -> np.ndarray:
    """The first `bits` signs of as many rotations as it takes, as booleans."""
    dim = u.shape[1]
    turns = -(-bits // dim)
    return np.concatenate([u @ rotation(dim, p.seed + r).T > 0 for r in range(turns)], axis=1)[:, :bits]


def coded(u: np.ndarray, p: CodeParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the signs of the rotated vector as booleans, its inner product with the unit vector of these signs (the
    correction factor), and how far an estimate by them may be off."""
    dim = u.shape[1]
    turned = u @ rotation(dim, p.seed).T
    code = turned > 0
    factor = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return code, factor, p.sigmas * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(1, dim - 1))


def upper(u: np.ndarray, code: np.ndarray, factor: np.ndarray, error: np.ndarray, p: CodeParams) -> np.ndarray:
    """Upper bounds of the cosines of unit vectors u with coded ones: unbiased estimates, and their errors on top."""
    dim = u.shape[1]
    signs_ = np.where(code, 1.0, -1.0) / np.sqrt(dim)
    return (u @ rotation(dim, p.seed).T) @ (signs_ / factor[:, None]).T + error[None]


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double) for each dimension; null and zero vectors and those with null or non-finite parts aren't among them."""
    column = column.cast(pa.large_list(pa.float64()))
    parts = column.flatten()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
    flat = parts.fill_null(np.nan).to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = flat[begin[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield rows[ok], x[ok]


def _coded(p: CodeParams):
    """Each usable vector with a digest of its numbers, its buckets and the bits that go along, its code, correction factor and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch["embedding"]):
                dim = x.shape[1]
                x = x + 0.0  # -0.0 and 0.0 are one number
                raw = K.mix(x.view(np.uint64) + K.seeded(dim, 41)[None]), K.mix(x.view(np.uint64) ^ K.seeded(dim, 43)[None])
                d1, d2 = (K.signed(K.mix(r.sum(axis=1, dtype=np.uint64) + np.uint64(dim))) for r in raw)
                bits = signs(unit(x), max(p.band_bits * p.bands, p.check_bits), p)
                weights = np.uint64(1) << np.arange(p.band_bits, dtype=np.uint64)
                parts = bits[:, : p.band_bits * p.bands].reshape(len(x), p.bands, p.band_bits) @ weights
                keys = K.mix((parts << np.uint64(16)) + np.arange(p.bands, dtype=np.uint64)[None] + np.uint64(dim << 48))
                check = np.packbits(bits[:, : p.check_bits], axis=1)
                code, factor, error = coded(unit(x), p)
                code = np.packbits(code, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(pa.array(rows)), pa.array(d1), pa.array(d2), pa.array([k.tobytes() for k in K.signed(keys).astype(">i8")], pa.binary()), pa.array([c.tobytes() for c in check], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.array(error)],
                    names=["vec_id", "d1", "d2", "keys", "check", "vector", "code", "factor", "error"],
                )

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch["keys"].to_pylist()
        keys = np.frombuffer(b"".join(raw), ">i8").astype(np.int64)
        owner = np.repeat(np.arange(len(raw)), len(keys) // max(1, len(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch["node"].take(pa.array(owner)), batch["check"].take(pa.array(owner))], names=["key", "node", "check"])


class Forest:
    """Disjoint sets of the places 0..n-1, with labels kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others[self.label[others] != self.label[i]].tolist():
            if self.label[j] != self.label[i]:
                self.label[self.label == self.label[j]] = self.label[i]
                self.edges.append((i, j))


def _likely(p: CodeParams):
    """Within runs of rows of one bucket: pairs whose codes differ in so few bits that they may be linked, as a forest for large runs."""
    at = np.arccos(p.cosine) / np.pi
    most = int(np.ceil(p.check_bits * at + p.sigmas * np.sqrt(p.check_bits * at * (1 - at))))

    def pairs(node: np.ndarray, code: np.ndarray, begin: np.ndarray, end: np.ndarray):
        size = end - begin
        a, b = [], []
        small = size <= 32
        for far in range(1, int(size[small].max(initial=1))):
            i = K.spread(begin[small], end[small] - 1 - far)
            near = np.bitwise_count(code[i] ^ code[i + far]).sum(axis=1) <= most
            a.append(node[i[near]])
            b.append(node[i[near] + far])
        for lo, hi in zip(begin[~small].tolist(), end[~small].tolist(), strict=True):
            part, forest = code[lo:hi], Forest(hi - lo)
            for i in range(hi - lo - 1):
                rest = np.flatnonzero(forest.label[i + 1 :] != forest.label[i]) + i + 1
                if len(rest):
                    forest.join(i, rest[np.bitwise_count(part[i] ^ part[rest]).sum(axis=1) <= most])
            if forest.edges:
                e = np.array(forest.edges) + lo
                a.append(node[e[:, 0]])
                b.append(node[e[:, 1]])
        both = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = (np.stack([batch[c].to_numpy() for c in ("key", "i", "j")], axis=1), batch["node"].to_numpy(), np.frombuffer(b"".join(batch["check"].to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            held = now if held is None else tuple(map(np.concatenate, zip(held, now, strict=True)))
            key = held[0]
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(cut):  # the last run may go on in the next batch
                yield pairs(held[1], held[2], np.concatenate(([0], cut[:-1])), cut)
                held = tuple(x[cut[-1] :] for x in held)
        if held is not None and len(held[0]):
            yield pairs(held[1], held[2], np.zeros(1, np.int64), np.array([len(held[0])]))

    return run


def _linked(p: CodeParams):
    """All links within a group, or between two chunks of one: each vector's number of linked rows, and a forest."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        node, rows = table["node"].to_numpy(), table["rows"].to_numpy()
        raw, codes = table["vector"].to_pylist(), table["code"].to_pylist()
        factor, error = table["factor"].to_numpy(), table["error"].to_numpy()
        count, edges = np.zeros(len(node), np.int64), []
        forest = Forest(len(node))
        own = table["own"].to_numpy()
        for size in {len(r) for r in raw}:
            pick = np.array([k for k, r in enumerate(raw) if len(r) == size])
            u = unit(np.frombuffer(b"".join(raw[k] for k in pick), np.float64).reshape(len(pick), -1))
            packed = np.frombuffer(b"".join(codes[k] for k in pick), np.uint8).reshape(len(pick), -1)
            code = np.unpackbits(packed, axis=1)[:, : u.shape[1]].astype(bool)
            for begin in range(0, len(pick), 512):
                part = slice(begin, min(begin + 512, len(pick)))
                may = upper(u[part], code, factor[pick], error[pick], p) >= p.cosine
                may[np.arange(part.stop - part.start), np.arange(part.start, part.stop)] = False
                if i != j:
                    may &= own[pick][part][:, None] != own[pick][None]
                x, y = np.nonzero(may)
                exact = np.concatenate([(u[begin + x[k : k + 65536]] * u[y[k : k + 65536]]).sum(axis=1) for k in range(0, max(1, len(x)), 65536)])
                yes = exact >= p.cosine
                x, y = x[yes] + begin, y[yes]
                count[pick] += np.bincount(x, rows[pick][y], len(pick)).astype(np.int64)
                for k in np.unique(x):
                    forest.join(int(pick[k]), pick[y[x == k]])
        a, b = [int(node[x]) for x, _ in forest.edges], [int(node[y]) for _, y in forest.edges]
        seen = np.flatnonzero(count)
        return pa.table({"a": pa.array([*a, *node[seen].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(seen)], pa.int64()), "n": pa.array([0] * len(a) + count[seen].tolist(), pa.int64())})

    return run


def in_pairs_of_chunks(df: DataFrame, chunks: str) -> DataFrame:
    """Each row once for each pair of chunks that its own is in, as columns own, i and j."""
    own = F.pmod(F.xxhash64("node"), F.col(chunks)).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col(chunks).cast("int") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return df.withColumn("own", own).withColumn("pair", F.explode(pair)).select(*df.columns, "own", "pair.i", "pair.j").drop(chunks)


def near_duplicates(vectors: DataFrame, params: CodeParams = CodeParams()) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows are linked if the cosine of their vectors, in double precision, is at least `cosine`. Null and zero vectors,
    those with null or non-finite parts, and vectors of different length link with nothing. A row repeated links
    with its copy. A null vec_id counts as larger than others and its component may be null. component_id is the
    smallest vec_id that links lead to. Other columns are ignored; an empty table gives an empty result.

    Equal vectors form a node. Each node's vector is rotated at random; the signs are its code, whose bands are
    buckets. Codes of a bucket's nodes bound their angles; nodes that may be linked form groups, to which each
    vector goes once. There, the stored codes and correction factors give unbiased estimates of inner products, and
    pairs whose upper bound reaches the threshold are computed exactly. Large buckets and groups are dealt out as pairs of chunks.
    """
    p = params
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    coded = land(rows.mapInArrow(_coded(p), "vec_id long, d1 long, d2 long, keys binary, check binary, vector binary, code binary, factor double, error double"), "codes")
    nodes = coded.groupBy("d1", "d2").agg(F.count("*").alias("rows"), F.min("vec_id").alias("low"), F.first("keys").alias("keys"), F.first("check").alias("check"), *(F.first(c).alias(c) for c in ("vector", "code", "factor", "error")))
    nodes = land(nodes.withColumn("node", F.xxhash64("d1", "d2")), "nodes")
    by = nodes.select("node", "keys", "check").mapInArrow(_buckets, "key long, node long, check binary")
    # counts of keys are put together before they are shuffled, and AQE splits hot keys of the join
    by = by.join(by.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    by = in_pairs_of_chunks(by.withColumn("chunks", F.ceil(F.col("n") / p.chunk)).drop("n"), "chunks").select("key", "i", "j", "node", "check")
    likely = by.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_likely(p), "a long, b long")
    group = connected_components(likely).withColumnRenamed("id", "node").withColumnRenamed("component", "group")
    size = group.groupBy("group").agg(F.ceil(F.count("*") / p.chunk).alias("chunks"))
    members = nodes.select("node", "rows", "vector", "code", "factor", "error").join(group, "node").join(size, "group")
    tasks = in_pairs_of_chunks(members, "chunks").groupBy("group", "i", "j")
    found = land(tasks.applyInArrow(_linked(p), "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    part = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    ids = nodes.select("node", "low", "rows").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = ids.groupBy("component").agg(F.min("low").alias("component_id"))
    named = ids.join(lows, "component").join(links, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    named = nodes.select("d1", "d2", "node").join(named, "node").drop("node")
    usable = coded.select("vec_id", "d1", "d2").join(named, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _usable() -> F.Column:
    x = F.col("embedding")
    big = float("inf")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != big)
    return x.isNotNull() & F.forall(x, fine) & F.exists(x, lambda v: v != 0)
