"""Pairs of like vectors within scopes of any size: banded sign codes propose them, exact cosines decide; at low thresholds blocks compare all."""

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vector as V


class Bands(NamedTuple):
    #: a pair at the threshold shares no band with this probability at most, one above it with less
    missed: float = 1e-6
    #: bands of a vector at most: low thresholds get fewer bits in each band instead, and more pairs to decide
    most: int = 256
    #: scopes of up to so many vectors are compared all with all
    small: int = 64
    #: vectors of a block, where larger scopes are compared all with all too
    block: int = 1024


def shape(n: int, least: float, p: Bands = Bands()) -> tuple[int, int]:
    """(bits, bands) for a scope of n vectors: a bit more whenever n doubles, so that unlike vectors meet in proportion to n, and as many
    bands as keep the missed pairs below p.missed. A bit of two vectors at an angle t agrees with probability 1 - t / pi."""
    agree = 1 - acos(max(-1.0, min(1.0, least))) / pi
    bits = max(1, ceil(log2(max(2, n))))
    while bits > 1 and (agree == 0 or log(p.missed) / log(1 - min(agree**bits, 1 - 1e-12)) > p.most):
        bits -= 1
    return bits, max(1, min(p.most, ceil(log(p.missed) / log(1 - min(agree**bits, 1 - 1e-12)))))


@lru_cache(maxsize=8)
def _planes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((n, dim)).T


def codes(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """A number for each row and band: the signs of the row's products with the band's random planes."""
    signs = (x @ _planes(x.shape[1], bits * bands) > 0).reshape(len(x), bands, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _keys(least: float, p: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["vector"]
            size = np.asarray(column.value_lengths().fill_null(0))
            flat, end = column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False), np.cumsum(size)
            bits = np.array([shape(n, least, p)[0] for n in batch["n"].to_pylist()], np.int64)
            for dim, b in sorted({*zip(size.tolist(), bits.tolist(), strict=True)}):
                rows = np.flatnonzero((size == dim) & (bits == b))
                x = flat[(end[rows] - dim)[:, None] + np.arange(dim)]
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) if dim else np.zeros(len(rows), bool)
                rows, x = rows[fine], x[fine]
                _, bands = shape(1 << int(b), least, p)
                for i in range(0, len(rows), 1024):
                    part = rows[i : i + 1024]
                    c = codes(x[i : i + 1024], int(b), bands)
                    at = pa.array(np.repeat(part, bands))
                    yield pa.RecordBatch.from_arrays([batch["scope"].take(at), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(part))), pa.array(c.reshape(-1)), batch["id"].take(at)], names=["scope", "band", "code", "id"])

    return run


def scope_of(*columns: str) -> Column:
    """One text for the values of the columns; null is a value of its own."""
    return F.to_json(F.struct(*columns))


def sparse(least: float, p: Bands = Bands()) -> bool:
    """Whether bands propose fewer pairs of unlike vectors than there are, in large scopes at least."""
    bits, bands = shape(1 << 40, least, p)
    return bands < 1 << bits


def _block_pairs(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column, ids, first = table["vector"].combine_chunks(), table["id"].combine_chunks(), table["first"].to_numpy()
        size = np.asarray(column.value_lengths())
        flat, end = column.flatten().to_numpy(), np.cumsum(size)
        found = []
        for dim in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == dim)
            x = flat[(end[rows] - dim)[:, None] + np.arange(dim)]
            norm = np.sqrt((x * x).sum(axis=1))
            rows, x = rows[norm > 0], x[norm > 0] / norm[norm > 0, None]
            one, two = first[rows], table["second"].to_numpy()[rows]
            c = x[one] @ x[two].T
            i, j = rows[one], rows[two]
            # within a block a row stands on both sides: of the two orders one is kept
            at = np.nonzero((c >= least) & ((i[:, None] < j[None, :]) | (not (one & two).any())))
            found.append((i[at[0]], j[at[1]], c[at]))
        i, j, c = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "cosine": pa.array(c, pa.float64())})

    return run


def block_pairs(sized: DataFrame, least: float, p: Bands = Bands()) -> DataFrame:
    """(a, b, cosine), a < b, of rows (id, scope, vector, n) in one scope of n whose vectors have a cosine of `least`: none is missed.

    A scope is dealt in blocks by a hash of the id, and each two blocks meet in one group of a task, so that no task holds a scope. All pairs are compared.
    """
    blocks = F.ceil(F.col("n") / p.block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    met = sized.select("id", "scope", "vector", own.alias("own"), F.explode(pair).alias("pair"))
    met = met.select("scope", "pair.i", "pair.j", (F.col("own") == F.col("pair.i")).alias("first"), (F.col("own") == F.col("pair.j")).alias("second"), "id", "vector")
    id_type = sized.schema["id"].dataType.simpleString()
    # a number of partitions of its own: what is read is small for the work it makes, and small partitions would be put together
    tasks = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope", "i", "j")
    found = tasks.groupBy("scope", "i", "j").applyInArrow(_block_pairs(least), f"a {id_type}, b {id_type}, cosine double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def near_pairs(rows: DataFrame, least: float, p: Bands = Bands(), digits: int | None = 9) -> DataFrame:
    """(a, b, cosine), a < b, of rows (id, scope, vector) in one scope whose vectors have a cosine of `least` (above 0) when rounded to
    `digits`, or as it is with None; so it is returned.

    Ids are distinct. Where bands propose fewer pairs than there are (see sparse), a pair at the threshold is missed in scopes of more than p.small
    vectors with probability p.missed at most; what is returned is exact, and the work grows with the rows times their bands and with the pairs that
    are near, not with the square of a scope. At lower thresholds most pairs would be proposed: there all are compared in blocks, and none is missed.
    Null, zero and non-finite vectors are near nothing, and so are vectors of different lengths.
    """
    shown = lambda c: c if digits is None else F.round(c, digits)
    rows = rows.where("vector is not null and scope is not null").select("id", "scope", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    sized = rows.join(rows.groupBy("scope").agg(F.count("*").alias("n")), "scope")
    few = sized.where(F.col("n") <= p.small).select("scope", "id")
    direct = few.alias("x").join(few.alias("y"), "scope").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    id_type = rows.schema["id"].dataType.simpleString()
    va, vb = (rows.select(F.col("id").alias(s), F.col("vector").alias(f"v{s}")) for s in "ab")
    cosines = lambda pairs: pairs.join(va, "a").join(vb, "b").select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cosine"))
    if not sparse(least, p):
        # what rounds up to the threshold is kept until it is rounded
        both = cosines(direct).union(block_pairs(sized.where(F.col("n") > p.small), least - 1e-12 if digits is None else least - 10.0**-digits, p))
        return both.withColumn("cosine", shown(F.col("cosine"))).where(F.col("cosine") >= least)
    keys = sized.where(F.col("n") > p.small).mapInArrow(_keys(least, p), f"scope string, band int, code long, id {id_type}")
    key = ["scope", "band", "code"]
    met = keys.alias("x").join(keys.alias("y"), key).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return cosines(direct.union(met)).withColumn("cosine", shown(F.col("cosine"))).where(F.col("cosine") >= least)
