"""Exact repeats of a fixed width: the Spark jobs that the two substring operators share.

A text is a sequence of units (bytes or words). A *window* is `width` consecutive units of one text. An
operator picks *anchors*: places in a text that equal windows share. All windows around one anchor form a
*block* (a range of starts). For each block two hashes travel: `k` of what all its windows have in common
and `u` of all that they span. Blocks that agree in k and u hold equal windows start by start, so one
record settles the whole block; blocks alone with their k hold no repeated window. Only blocks that share
k but differ in u (the edges of repeats) are looked at window by window: small groups of byte segments by
putting their suffixes in order, others by a 122-bit hash of each window. Every grouping is by a content hash, no
group is collected, and no record is dropped.

Within a slice, what repeats is settled before anything is shuffled: of equal blocks, and of equal windows, only
those speak to other slices whose answer isn't known, and of very many edges of one core a few speak for all. So a passage in a
third of all rows sends a bounded number of records for each slice.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.scratch import land

#: of kind: REF a reference block for FIRST; HOT one that speaks for many edges; DONE and OPEN are settled (their k is their own)
REF, HOT, DONE, OPEN = 1, 2, 4, 8
RECORDS = "id long, t1 long, t2 int, s0 int, s1 int, kind byte, k long, u long"
FOUND = "kind int, id long, t1 long, t2 int, packed binary, sure binary, w1 long, w2 long, s int, n_units long, n_removed long, n_spans long, sha string, kept string, rest string"
RESULT = "id long, n_units long, n_removed long, n_spans long, sha string, kept string, rest string"
#: what becomes of a block: its windows repeat, are compared by hash, or are compared in corpus order
SURE, BY_HASH, IN_ORDER = 1, 2, 3
#: edges of repeats that share a core and are compared in one task; groups with more go by hash, which is as exact
ORDER_GROUP = 512
#: which windows are removed: all that start elsewhere too; all but one of equal ones; those that start in a text of a smaller id
NONE, ONE, FIRST = "none", "one", "first"


@dataclass(frozen=True)
class Units:
    """A slice seen as units: two hash lanes over them and the index of each text's first unit."""

    sums: tuple[K.Sums, K.Sums]
    offs: np.ndarray


@dataclass(frozen=True)
class Scheme:
    """What an operator adds: how texts become units, which blocks they have, and how kept units are put together."""

    width: int
    units: Callable[[np.ndarray, np.ndarray], Units]
    #: units -> (text index, first start, last start, reference?, k, u), starts being indices of units
    blocks: Callable[[Units], tuple]
    #: (text bytes, keep mask of units) -> remaining bytes
    join: Callable[[np.ndarray, np.ndarray], bytes]
    #: what stays of equal windows: NONE, ONE (the least by id, key and start) or FIRST (all in texts of the smallest id)
    stays: str
    #: (data, offs, starts) -> the starts whose windows repeat and a number for each set of equal ones, for units that are
    #: bytes; None: all go by hash
    in_order: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
    #: edges of one core in one slice above which a few speak for all
    slice_edges: int = 16


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and the number of each place's run; keys are in order."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _settled(stays: str, begin: np.ndarray, run: np.ndarray, row: np.ndarray, at: np.ndarray, ids: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of equal things ordered by id, key and place: (removed for sure, speaks to other slices)."""
    if stays == FIRST:
        low = np.minimum.reduceat(np.where(ref, ids, np.iinfo(np.int64).max), begin)[run]
        return low < ids, low >= ids
    least = (row == row[begin][run]) & (at == at[begin][run])
    many = np.diff(np.append(begin, len(run)))[run] > 1
    speaks = np.zeros(len(run), bool)
    speaks[begin] = True
    return (many if stays == NONE else ~least), speaks


def _ranges(at: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts of texts, those that touch put together."""
    order = np.lexsort((s0, at))
    at, s0, s1 = at[order], s0[order], s1[order]
    apart = np.ones(len(at), bool)
    apart[1:] = (at[1:] != at[:-1]) | (s0[1:] > s1[:-1] + 1)
    first = np.flatnonzero(apart)
    return at[first], s0[first], np.maximum.reduceat(s1, first) if len(first) else s1


def _speakers(scheme: Scheme, k: np.ndarray, u: np.ndarray, ids: np.ndarray, ref: np.ndarray, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hot, open) of records in order of k and u: of cores with very many speaking edges, those that speak for all and those that don't."""
    hot, open_ = np.zeros(len(k), bool), np.zeros(len(k), bool)
    begin, run = _runs(k)
    count = np.bincount(run, speaks)
    for r in np.flatnonzero(count > scheme.slice_edges):
        own = np.flatnonzero(speaks[begin[r] : begin[r + 1] if r + 1 < len(begin) else len(k)]) + begin[r]
        if u[own[0]] == u[own[-1]]:
            continue
        told = {int(own[0]), int(own[-1])}
        if scheme.stays == FIRST:  # others ask by the smallest id of a reference block and tell by the largest of all
            told |= {int(own[np.argmax(ids[own])])} | ({int(own[ref[own]][np.argmin(ids[own[ref[own]]])])} if ref[own].any() else set())
        open_[own] = True
        open_[list(told)] = False
        hot[list(told)] = True
    return hot, open_


def _narrowed(scheme: Scheme, ids: np.ndarray, t1: np.ndarray, t2: np.ndarray, blocks: tuple) -> tuple:
    """A slice's blocks as (text index, first start, last start, kind, k, u), with all that can be told within the slice settled."""
    at, s0, s1, ref, k, u = blocks
    order = np.argsort(k, kind="stable")
    begin, run = _runs(k[order]) if len(order) else (order, order)
    again = order[np.bincount(run)[run] > 1] if len(order) else order
    if not len(again):
        return at, s0, s1, ref.astype(np.int8), k, u
    row = _row(t1, t2)
    again = again[np.lexsort((s0[again], row[at[again]], ids[at[again]], u[again], k[again]))]
    begin, run = _runs(k[again], u[again])
    sure, speaks = _settled(scheme.stays, begin, run, row[at[again]], s0[again], ids[at[again]], ref[again])
    hot, open_ = _speakers(scheme, k[again], u[again], ids[at[again]], ref[again], speaks)
    asks = np.ones(len(k), bool)
    asks[again[~speaks | open_]] = False
    kind = ref.astype(np.int8)
    kind[again[hot]] |= HOT
    parts = [(at[asks], s0[asks], s1[asks], kind[asks], k[asks], u[asks])]
    for which, code in ((sure, DONE), (open_, OPEN)):
        a, b, c = _ranges(at[again[which]], s0[again[which]], s1[again[which]])
        own = K.mix(t1[a].view(np.uint64) + K.mix(b.astype(np.uint64) + np.uint64(code)))
        parts.append((a, b, c, np.full(len(a), code, np.int8), own, own))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _row(t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """A number for each key, in order of keys; equal keys have equal numbers."""
    order = np.lexsort((t2, t1))
    out = np.empty(len(order), np.int64)
    out[order] = _runs(t1[order], t2[order])[1]
    return out


def _records(scheme: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t1, t2 = (batch[c].to_numpy() for c in ("id", "t1", "t2"))
            for i, j, data, offs in K.slices(batch["text"]):
                units = scheme.units(data, offs)
                at, s0, s1, *rest = scheme.blocks(units)
                base = units.offs[at]
                at, s0, s1, kind, k, u = _narrowed(scheme, ids[i:j], t1[i:j], t2[i:j], (at, s0 - base, s1 - base, *rest))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i + at]), pa.array(t1[i + at]), pa.array(t2[i + at]), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)), pa.array(kind), pa.array(K.signed(k)), pa.array(K.signed(u))],
                        names=["id", "t1", "t2", "s0", "s1", "kind", "k", "u"],
                    )

    return run


def _result(scheme: Scheme, text: bytes, n: int, starts: np.ndarray, keep_text: bool) -> tuple:
    """starts: sorted window starts to remove."""
    keep, data = np.ones(n, bool), np.frombuffer(text, np.uint8)
    if len(starts):
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + scheme.width, -1)
        keep = np.cumsum(edge[:-1]) == 0
    left = scheme.join(data, keep)
    spans = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
    return n, int(n - keep.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None


def _unmark(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First starts, last starts and kinds from longs of 31, 30 and 2 bits."""
    s0 = marks >> 32
    return s0, s0 + ((marks >> 2) & ((1 << 30) - 1)), marks & 3


def _windows(scheme: Scheme, ids: np.ndarray, row: np.ndarray, at: np.ndarray, s: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows compared by hash: (removed for sure, speaks to other slices), as masks."""
    sure, speaks = np.zeros(len(at), bool), np.ones(len(at), bool)
    if len(at):
        order = np.lexsort((s, row[at], ids[at], w2, w1))
        begin, run = _runs(w1[order], w2[order])
        sure[order], speaks[order] = _settled(scheme.stays, begin, run, row[at[order]], s[order], ids[at[order]], np.ones(len(order), bool))
    return sure, speaks


def _look(scheme: Scheme, keep_text: bool) -> Callable:
    """Texts with their marked blocks: a finished result (kind 0), or a packed text (1), its open windows (2) and open segments (3)."""
    blank = dict.fromkeys([f.split()[0] for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            ids, t1, t2, marks, segs, rest = batch["id"].to_numpy(), batch["t1"].to_numpy(), batch["t2"].to_numpy(), batch["marks"], batch["segs"], batch["rest"]
            for i, j, data, offs in K.slices(batch["text"]):
                whole = scheme.units(data, offs)
                base = whole.offs[:-1]
                told = [_unmark(np.array(marks[d].as_py() or [], np.int64)) for d in range(i, j)]
                sure = [np.unique(K.spread(s0[m == SURE], s1[m == SURE])) for s0, s1, m in told]
                asked = [np.unique(K.spread(s0[m == BY_HASH], s1[m == BY_HASH])) for s0, s1, m in told]
                at, s = np.repeat(np.arange(j - i), [len(a) for a in asked]), np.concatenate(asked)
                w1, w2 = (lane.of(base[at] + s, base[at] + s + scheme.width) for lane in whole.sums)
                known, speaks = _windows(scheme, ids[i:j], _row(t1[i:j], t2[i:j]), at, s, w1, w2)
                late = np.bincount(at[speaks], minlength=j - i) > 0
                ends = np.searchsorted(at, np.arange(j - i + 1))
                rows = []
                for d in range(j - i):
                    text = data[offs[d] : offs[d + 1]].tobytes()
                    mine = slice(ends[d], ends[d + 1])
                    starts = np.union1d(sure[d], s[mine][known[mine]]) if known[mine].any() else sure[d]
                    row = blank | {"id": ids[i + d], "t1": t1[i + d], "t2": t2[i + d]}
                    doc, own = row | {"rest": rest[i + d].as_py()}, segs[i + d].as_py() or []
                    if late[d] or own:
                        rows.append(doc | {"kind": 1, "packed": pack(text), "sure": starts.astype(np.int32).tobytes()})
                        for seg in own:
                            a, b, _ = _unmark(np.array([seg["mark"]], np.int64))
                            rows.append(row | {"kind": 3, "s": int(a[0]), "w1": seg["k"], "packed": text[int(a[0]) : int(b[0]) + scheme.width]})
                    else:
                        got = _result(scheme, text, int(whole.offs[d + 1] - whole.offs[d]), starts, keep_text)
                        rows.append(doc | {"kind": 0} | dict(zip(("n_units", "n_removed", "n_spans", "sha", "kept"), got, strict=True)))
                yield _batch(pd.DataFrame(rows))
                if speaks.any():
                    d = i + at[speaks]
                    yield _batch(pd.DataFrame(blank | {"kind": 2, "id": ids[d], "t1": t1[d], "t2": t2[d], "w1": K.signed(w1[speaks]), "w2": K.signed(w2[speaks]), "s": s[speaks]}))

    return run


def _in_order(scheme: Scheme) -> Callable:
    """Segments, those of a group together: the starts that repeat. Groups are small, and several make one collection."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        arr = K.as_bytes(table["packed"])
        offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        found, equal = scheme.in_order(data, offs, K.spread(offs[:-1], offs[1:] - scheme.width))
        row = np.searchsorted(offs, found, "right") - 1
        ids, t1, t2, s = (table[c].to_numpy() for c in ("id", "t1", "t2", "s"))
        s = s[row] + found - offs[row]
        if len(found) and scheme.stays == ONE:
            key = _row(t1, t2)[row]
            order = np.lexsort((s, key, ids[row], equal))
            begin, run = _runs(equal[order])
            gone = order[_settled(ONE, begin, run, key[order], s[order], ids[row[order]], np.ones(len(order), bool))[0]]
            row, s = row[gone], s[gone]
        return pa.RecordBatch.from_arrays([pa.array(t1[row]), pa.array(t2[row]), pa.array(s.astype(np.int32))], names=["t1", "t2", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            k = batch["w1"].to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            last = held[-1]["w1"][-1].as_py() if held else None
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= K.SLICE_BYTES and k[a] != last:
                    yield work(held)
                    held, size = [], 0
                part = batch.slice(a, b - a)
                held.append(part)
                size += sum(len(x) for x in part["packed"].to_pylist())
                last = k[a]
        if held:
            yield work(held)

    return run


_ARROW = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int32()), ("packed", pa.binary()), ("sure", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()), ("s", pa.int32()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("kept", pa.string()), ("rest", pa.string())])


def _batch(frame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema=_ARROW, preserve_index=False)


def _finish(scheme: Scheme, keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = unpack(r["packed"]) if r["packed"] else b""
                n = int(scheme.units(np.frombuffer(text, np.uint8), np.array([0, len(text)])).offs[-1])
                starts = np.concatenate((np.frombuffer(r["sure"], np.int32), np.array(r["found"] or [], np.int32))).astype(np.int64)
                got = _result(scheme, text, n, np.unique(starts), keep_text)
                out.append({"id": r["id"], "rest": r["rest"]} | dict(zip(("n_units", "n_removed", "n_spans", "sha", "kept"), got, strict=True)))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=_DONE)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_DONE)

    return run


_DONE = pa.schema([("id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("kept", pa.string()), ("rest", pa.string())])


def remove_repeats(docs: DataFrame, scheme: Scheme, keep_text: bool = False) -> DataFrame:
    """docs: keyed documents. Returns RESULT, one row for each row of docs."""
    key, first = ["t1", "t2"], scheme.stays == FIRST
    # ids are compared only where some copy stays
    slim = docs.select((F.lit(0).cast("long") if scheme.stays == NONE else F.col("id")).alias("id"), *key, "text")
    records = slim.mapInArrow(_records(scheme), RECORDS)
    one, same = Window.partitionBy("k"), Window.partitionBy("k", "u")
    has = lambda bit: F.col("kind").bitwiseAND(F.lit(bit).cast("byte")) != 0
    r = records.withColumn("me", F.struct("id", *key, "s0"))
    if first:
        ref = F.min(F.when(has(REF), F.col("id")))
        r = r.withColumn("low", ref.over(same)).withColumn("low_k", ref.over(one)).withColumn("high_k", F.max("id").over(one))
        r = r.withColumn("mixed", F.min("u").over(one) != F.max("u").over(one))
        sure = F.coalesce(F.col("low") < F.col("id"), F.lit(False))
        asks = ~sure & F.coalesce(F.col("low_k") < F.col("id"), F.lit(False))
        tells = has(REF) & ~sure & (F.col("high_k") > F.col("id"))
    else:
        r = r.withColumn("n", F.count("*").over(same)).withColumn("first", F.min("me").over(same)).withColumn("all", F.count("*").over(one))
        r = r.withColumn("mixed", F.col("n") < F.col("all"))
        sure = (F.col("n") > 1) & ~has(OPEN) if scheme.stays == NONE else F.col("me") != F.col("first")
        asks = F.col("n") == 1
        tells = F.col("me") == F.col("first")
    r = r.withColumn("sure", sure | has(DONE)).withColumn("open", (F.col("mixed") & (asks | tells) & ~has(DONE)) | has(OPEN))
    if scheme.in_order is None:
        how = F.lit(BY_HASH)
    else:
        few = (F.sum(F.col("open").cast("int")).over(one) <= ORDER_GROUP) & ~F.max(has(HOT)).over(one) & ~has(OPEN)
        how = F.when(few, F.lit(IN_ORDER)).otherwise(F.lit(BY_HASH))
    r = r.withColumn("how", how).where(F.col("sure") | F.col("open"))
    kinds = F.filter(F.array(F.when(F.col("sure"), F.lit(SURE)), F.when(F.col("open"), F.col("how"))), lambda x: x.isNotNull())
    r = r.withColumn("m", F.explode(kinds))
    mark = F.shiftleft(F.col("s0").cast("long"), 32).bitwiseOR(F.shiftleft((F.col("s1") - F.col("s0")).cast("long"), 2)).bitwiseOR(F.col("m").cast("long"))
    r = r.withColumn("mark", mark)
    ordered = F.col("m") == IN_ORDER
    marks = r.groupBy(*key).agg(F.collect_list(F.when(~ordered, F.col("mark"))).alias("marks"), F.collect_list(F.when(ordered, F.struct("mark", "k"))).alias("segs"))
    # written, so that the records' shuffle is freed before the texts'
    marks = land(marks, "marks")
    seen = docs.join(marks, key, "left").select("id", *key, "text", "rest", "marks", "segs")
    found = land(seen.mapInArrow(_look(scheme, keep_text), FOUND), "repeats")
    wins = found.where("kind = 2").select("id", *key, "w1", "w2", "s")
    w = Window.partitionBy("w1", "w2")
    if first:
        hit = wins.withColumn("low", F.min("id").over(w)).where("low < id")
    elif scheme.stays == NONE:
        hit = wins.withColumn("n", F.count("*").over(w)).where("n > 1")
    else:
        hit = wins.withColumn("me", F.struct("id", *key, "s")).withColumn("least", F.min("me").over(w)).where("me <> least")
    hit = hit.select(*key, "s")
    if scheme.in_order is not None:
        segs = found.where("kind = 3").select("id", *key, "w1", "s", "packed")
        # sorting suffixes is slow for its bytes, so these partitions aren't to be put together by size
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segs = segs.repartition(tasks, "w1").sortWithinPartitions("w1")
        hit = hit.union(segs.mapInArrow(_in_order(scheme), "t1 long, t2 int, s int"))
    hit = hit.groupBy(*key).agg(F.collect_list("s").alias("found"))
    late = found.where("kind = 1").select("id", *key, "packed", "sure", "rest").join(hit, key, "left")
    cols = [f.split()[0] for f in RESULT.split(", ")]
    return found.where("kind = 0").select(*cols).unionByName(late.select("id", "packed", "sure", "rest", "found").mapInArrow(_finish(scheme, keep_text), RESULT))


def known_id() -> F.Column:
    """A null doc_id counts as the smallest of all."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(K.MIN_ID))


def row_key() -> list[F.Column]:
    """t1 and t2, 96 bits of two hashes of a row's id and text: rows agree in them only if they are repeated in full."""
    text = F.col("text").cast("string")
    return [F.xxhash64(known_id(), text).alias("t1"), F.hash(text, known_id()).alias("t2")]


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, t1, t2, text, rest): rest has the columns to carry along, as JSON."""
    rest = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    return docs.select(known_id().alias("id"), *row_key(), F.col("text").cast("string").alias("text"), rest.alias("rest"))


def carried(docs: DataFrame, carry: tuple[str, ...]) -> list[F.Column]:
    """The columns of rest, with their types in docs."""
    if not carry:
        return []
    parsed = F.from_json("rest", docs.select(*carry).schema)
    return [parsed[c].alias(c) for c in carry]


def doc_id() -> F.Column:
    return F.when(F.col("id") != F.lit(K.MIN_ID), F.col("id")).alias("doc_id")
