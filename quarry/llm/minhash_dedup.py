"""MinHash near-dedup: fast similarity sketches, banding, and a check of every link on full sets."""

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import repeats as R
from quarry.llm.components import connected_components
from quarry.llm.scratch import land


class SketchParams(NamedTuple):
    shingle: int = 5
    #: links need percent * |union| <= 100 * |intersection|
    percent: int = 80
    #: a pair of similarity 0.8 shares no band with probability (1 - 0.8**rows)**bands, 3e-7 here
    bands: int = 64
    rows: int = 7
    #: MB and rows of sets compared in one task; larger groups are compared in pairs of chunks
    chunk_mb: int = 8
    chunk_rows: int = 256


_SLICE = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, in order, and where each text's begin. Texts of fewer words have one for all words."""
    data = K.lower(data)
    s, e, woffs = K.words(data, offs)
    n = np.diff(woffs)
    sums = K.Sums(K.word_hashes(data, s, e), 1)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = K.spread(woffs[:-1], woffs[:-1] + count - 1)
    text = np.repeat(np.arange(len(n)), count)
    h = sums.of(begin, np.minimum(begin + size, woffs[1:][text]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def sketch(h: np.ndarray, offs: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketching: in each of the first `bins` rounds every element goes to one hashed bin; in as many
    further rounds, each for one bin, every element goes there. A bin keeps its earliest round's least value, and a
    text stops once its bins are full, so none stays empty. A text without elements has no values (all ones)."""
    texts = len(offs) - 1
    out = np.full((texts, bins), _NONE)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(texts), np.diff(offs))
    low = np.uint64((1 << 40) - 1)
    todo = np.diff(offs) > 0
    x, own = h, owner
    for r in range(bins):
        if not len(x):
            break
        v = K.mix(x + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        to = ((v >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, own * bins + to, np.uint64(r << 40) | (v & low))
        left = np.flatnonzero(todo)
        full = (out[left] != _NONE).all(axis=1)
        if full.any():
            todo[left[full]] = False
            stay = todo[own]
            x, own = x[stay], own[stay]
    rest = np.flatnonzero(todo)
    seeds = (np.arange(bins, 2 * bins, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    stamp = np.arange(bins, 2 * bins, dtype=np.uint64) << np.uint64(40)
    for d in rest:
        least = np.full(bins, _NONE)
        for a in range(offs[d], offs[d + 1], 1024):
            part = h[a : min(a + 1024, offs[d + 1])]
            least = np.minimum(least, (K.mix(part[:, None] + seeds[None, :]) & low).min(axis=0))
        out[d] = np.where(out[d] == _NONE, stamp | least, out[d])
    return out


def _sketches(p: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in K.slices(batch["text"], _SLICE):
                h, at = shingle_sets(data, offs, p.shingle)
                s = sketch(h, at, p.bands * p.rows).reshape(j - i, p.bands, p.rows)
                key = np.broadcast_to(K.seeded(p.bands, 5), (j - i, p.bands)).copy()
                for r in range(p.rows):
                    key = K.mix(key * np.uint64(31) + s[:, :, r])
                digest = np.frombuffer(b"".join(blake2b(t, digest_size=16).digest() for t in normalised(data, offs)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch["id"][i:j], batch["t1"][i:j], batch["t2"][i:j], pa.array(np.diff(at)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([k.tobytes() for k in K.signed(key).astype(">i8")], pa.binary())], names=["id", "t1", "t2", "n", "d1", "d2", "bands"])

    return run


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, to): nodes of a batch that share a key are edges to the least of them, under a key of their own, and
    only that one meets other batches. So a key that very many share sends one row for each batch."""
    for batch in batches:
        raw, node = batch["bands"].to_pylist(), batch["node"].to_numpy()
        keys = np.frombuffer(b"".join(raw), ">i8").astype(np.int64)
        node = np.repeat(node, len(keys) // max(1, len(raw)))
        order = np.lexsort((node, keys))
        keys, node = keys[order], node[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        low = node[new][np.cumsum(new) - 1] if len(keys) else node
        own = node == low
        yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(node[new]), pa.nulls(int(new.sum()), pa.int64())], names=["key", "node", "to"])
        if not own.all():
            edges = np.unique(np.stack((node[~own], low[~own])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[0]), pa.array(edges[1])], names=["key", "node", "to"])


def normalised(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Each text's words in lower case, a space between them."""
    raw = K.lower(data).tobytes()
    return [b" ".join(raw[offs[d] : offs[d + 1]].translate(_BLANK).split()) for d in range(len(offs) - 1)]


_BLANK = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def _words(p: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in K.slices(batch["text"], _SLICE):
                yield pa.RecordBatch.from_arrays([batch["group"][i:j], batch["chunks"][i:j], batch["node"][i:j], pa.array(normalised(data, offs), pa.binary())], names=["group", "chunks", "node", "words"])

    return run


def exact_set(words: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, of normalised words."""
    w = words.split(b" ") if words else []
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(nodes: np.ndarray, sets: list[np.ndarray], percent: int, holds: Callable[[int, int], bool]) -> tuple[list[int], list[int]]:
    """Links that connect, as all links do, the sets of a group (of hashes): a forest, of whose every edge holds(i, j) is true."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    begin = np.concatenate(([0], np.cumsum(size)))
    by_token = np.argsort(inverse, kind="stable")
    postings, first = owner[by_token], np.concatenate(([0], np.cumsum(df)))
    part = np.arange(m)
    a, b = [], []
    for at, i in enumerate(order):
        # only larger sets, up to where the size alone rules a link out
        until = int(np.searchsorted(size[order], size[i] * 100 // percent, "right"))
        later = order[at + 1 : until]
        later = later[part[later] != part[i]]
        if not len(later):
            continue
        t = inverse[begin[i] : begin[i + 1]]
        t = t[df[t] > 1]
        if not len(t):
            continue
        both = np.bincount(postings[K.spread(first[t], first[t + 1] - 1)], minlength=m)[later]
        for j in later[both * 100 >= percent * (size[i] + size[later] - both)]:
            if part[j] != part[i] and holds(int(i), int(j)):
                part[part == part[j]] = part[i]
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
    return a, b


def _verify(p: SketchParams):
    """Links of a group, or of two of its chunks: hashes of shingles find them, the shingles themselves confirm them."""

    def run(key, table):
        words = table["words"].to_pylist()
        data, offs = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))
        h, at = shingle_sets(data, offs, p.shingle)
        full = lru_cache(maxsize=4)(lambda i: exact_set(words[i], p.shingle))

        def holds(i: int, j: int) -> bool:
            both = len(full(i) & full(j))
            return 100 * both >= p.percent * (len(full(i)) + len(full(j)) - both)

        a, b = linked(table["node"].to_numpy(), [h[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], p.percent, holds)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _parts(docs: DataFrame, p: SketchParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows, classes of equal words, (node, id, component) of each class); a component is named by a node."""
    keyed = R.keyed(docs).drop("rest")
    all_ = land(keyed.mapInArrow(_sketches(p), "id long, t1 long, t2 int, n long, d1 long, d2 long, bands binary"), "sketches")
    classes = all_.where("n > 0").groupBy("n", "d1", "d2").agg(F.min_by(F.struct("id", "t1", "t2", "bands"), F.struct("id", "t1", "t2")).alias("r"))
    # one class can have the id of another (rows of one doc_id): a node is a class
    classes = land(classes.select("n", "d1", "d2", F.xxhash64("n", "d1", "d2").alias("node"), "r.id", "r.t1", "r.t2", "r.bands"), "classes")
    keys = classes.select("node", "bands").mapInArrow(_band_keys, "key long, node long, to long")
    low = F.coalesce("to", F.min("node").over(Window.partitionBy("key", F.col("to").isNull())))
    coarse = connected_components(keys.withColumn("low", low).where("low <> node").select(F.col("low").alias("a"), F.col("node").alias("b")))
    members = classes.select("node", "t1", "t2", "n").join(coarse.withColumnRenamed("id", "node"), "node").withColumnRenamed("component", "group")
    chunks = F.ceil(F.greatest(F.sum("n") * 8 / (p.chunk_mb << 20), F.count("*") / p.chunk_rows)).cast("int")
    members = members.join(members.groupBy("group").agg(chunks.alias("chunks")), "group").select("t1", "t2", "node", "group", "chunks")
    # rows repeated in full have one key: their class needs one of them
    sets = keyed.select("t1", "t2", "text").join(members, ["t1", "t2"]).select("group", "chunks", "node", "text").mapInArrow(_words(p), "group long, chunks int, node long, words binary")
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    tasks = sets.withColumn("pair", F.explode(pair)).select("group", "pair.i", "pair.j", "node", "words")
    links = tasks.groupBy("group", "i", "j").applyInArrow(_verify(p), "a long, b long")
    joined = connected_components(links).withColumnRenamed("id", "node")
    ids = classes.select("node", "id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return all_, classes, ids


def near_duplicates(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id and kept.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text's set has its distinct runs of `shingle` words,
    or all its words as one run if it has fewer. Null, empty and blank texts have an empty set and link with nothing.
    component_id is the smallest doc_id that links lead to. A null doc_id counts as the smallest, and comes
    back null. Rows repeated in full are in one component; of rows of one doc_id, all or none are kept. Other columns
    are ignored, and an empty table gives an empty result. A text has to fit in a task.

    Texts of equal words form a class (by a 128-bit digest), and only its first text goes on. Texts that share a band of their sketch form
    groups; each group's sets are compared in full, large groups by pairs of chunks, links are confirmed on the shingles
    themselves, and what was confirmed is joined into components.
    """
    all_, classes, ids = _parts(docs, params)
    lows = ids.groupBy("component").agg(F.min("id").alias("low"))
    named = classes.select("n", "d1", "d2", "node").join(ids.select("node", "component"), "node").join(lows, "component").select("n", "d1", "d2", "low")
    done = all_.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.coalesce("low", "id")
    return done.select(R.doc_id(), F.col("n").alias("n_shingles"), F.when(component != F.lit(K.MIN_ID), component).alias("component_id"), (component == F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """One row of docs (doc_id, text and others), whole, for each component of near duplicates: of its rows the least by doc_id and hashes of the text.

    Here a component is of texts, whatever ids they share: rows of one doc_id, or of none, that aren't near each other all stay.
    Null, empty and blank texts stay too; of any rows repeated in full (doc_id and text) one is left.
    """
    all_, classes, ids = _parts(docs, params)
    key = ["id", "t1", "t2"]
    texts = all_.groupBy("n", "d1", "d2", *key).agg(F.count("*").alias("copies"))
    least = texts.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct(*key, "copies")).alias("r"))
    parts = classes.select("n", "d1", "d2", "node").join(ids.select("node", "component"), "node")
    first = least.join(parts, ["n", "d1", "d2"]).groupBy("component").agg(F.min("r").alias("r")).select("r.*")
    kept = land(first.union(texts.where("n = 0").select(*key, "copies")), "kept")
    own = ["near_id", "near_t1", "near_t2"]
    rows = docs.select("*", R.known_id().alias(own[0]), *(c.alias(n) for c, n in zip(R.row_key(), own[1:], strict=True)))
    kept = kept.toDF(*own, "copies")
    once = rows.join(kept.where("copies = 1"), own, "left_semi")
    more = rows.join(kept.where("copies > 1"), own, "left_semi").dropDuplicates(own)
    return once.select(*docs.columns).union(more.select(*docs.columns))
