"""Phrase collocations: weighted n-grams of distinct pieces, counted by hash bucket in duckdb, scored by looked-up parts."""

import re
import shutil
import string
import tempfile
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import bloom
from quarry.llm import kernels as K
from quarry.llm.scratch import land


class PhraseParams(NamedTuple):
    #: words of the longest phrase, and occurrences from which one is a candidate
    longest: int = 4
    least: int = 30
    #: a longer candidate with this share of a phrase's occurrences stands for it
    percent: int = 80
    scale: int = 2_000_000
    top: int = 2000
    unknown: str = "und"
    #: parts of a lang that are ranked by themselves first
    parts: int = 32
    #: bytes of pieces whose n-grams are summed together before they are shuffled
    slice_bytes: int = 4 << 20
    #: memory of duckdb in a task; beyond it, it goes to the task's temporary folder
    duckdb_mb: int = 200
    #: bits for each frequent word or pair in the filter that spares longer n-grams, and the log2 of its greatest size (2**29 bits: 64 MB)
    filter_bits: int = 16
    filter_log2_most: int = 29


_ENDS = re.compile(rb"[.,;:!?\n-\r]")


def _cut(p: PhraseParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = defaultdict(Counter)
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in seen.items():
                if n:
                    arrays = [pa.array([lang] * len(n)), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array([x.count(b" ") + 1 for x in n], pa.int64()), pa.array(list(n.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "piece", "words", "m"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), K.as_bytes(batch["text"]), strict=True):
                raw = text.as_py()
                seen[p.unknown if lang is None else lang].update(b" ".join(w) for x in _ENDS.split(raw.lower()) if (w := x.split()))
                size += len(raw)
                if size > 4 * p.slice_bytes:
                    yield from told()
                    size = 0
        yield from told()

    return run


def pieces(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, piece, words, m): the distinct pieces of all texts, words joined by one space, and how often each occurs."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(_cut(params), "lang string, piece string, words long, m long")
    return cut.groupBy("lang", "piece").agg(F.max("words").alias("words"), F.sum("m").alias("m"))


def _lang_hash(langs: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in langs], np.uint64) << np.uint64(20)


def _strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The byte ranges s..e of data as strings."""
    offs = np.concatenate(([0], np.cumsum(e - s)))
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[K.spread(s, e - 1)]))).cast(pa.string())


def _summed(key: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal keys: (a place of each, the number of each place's key, the sum of m), all exact."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    # sums of whole numbers, in 64 bits
    return order[begin], which, np.add.reduceat(m[order], begin) if len(begin) else m[:0]


class _Slice:
    """Pieces of a task, end to end, as numbered words."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        piece = table["piece"].combine_chunks()
        _, _, self.data, offs = next(K.slices(piece, 1 << 62))
        lang = table["lang"].combine_chunks().dictionary_encode()
        self.langs, m = lang.dictionary.to_pylist(), table["m"].to_numpy()
        self.s, self.e, _ = K.words(self.data, offs)
        count = table["words"].to_numpy()
        word = pc.split_pattern(piece, " ").flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        piece = np.repeat(np.arange(len(count)), count)
        self.left = np.cumsum(count)[piece] - np.arange(len(word))  # words from here to the end of the piece
        self.lang, self.m = lang.indices.to_numpy()[piece].astype(np.int64), m[piece]
        self.word = word | self.lang << 32
        self.sums = K.byte_sums(self.data, 0)
        self.salt = _lang_hash(self.langs)

    def passing(self, n: int, shared) -> np.ndarray:
        """Whether the n words from each place on may be a frequent n-gram."""
        at = np.flatnonzero(self.left >= n)
        h = self.sums.of(self.s[at], self.e[at + n - 1]) ^ self.salt[self.lang[at]]
        out = np.zeros(len(self.word) + 1, bool)
        out[at[bloom.passing(h, *shared.value)]] = True
        return out

    def counted(self, sizes: range, fits: np.ndarray | None, of: int) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams and their sums for n in sizes: those whose every run of `of` words fits (None: all)."""
        at = np.arange(len(self.word))
        number = self.word  # of the n-gram at each of `at`
        for n in range(1, sizes.stop):
            ok = self.left[at] >= n
            if fits is not None and n >= of:
                ok &= fits[at + n - of]
            at, number = at[ok], number[ok]
            if n > 1:
                number = number << 32 | self.word[at + n - 1] & 0xFFFFFFFF
            one, number, m = _summed(number, self.m[at])
            if n not in sizes:
                continue
            own = at[one]
            lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[own]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(own), n, np.int32)), _strings(self.data, self.s[own], self.e[own + n - 1]), pa.array(m)], names=["lang", "words", "gram", "m"])


def _grams(p: PhraseParams, sizes: range, shared, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                slice_ = _Slice(held)
                yield from slice_.counted(sizes, slice_.passing(of, shared) if shared else None, of)
                held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > p.slice_bytes:
                yield from told()
                size = 0
        yield from told()

    return run


_GRAMS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("gram", pa.string()), ("m", pa.int64())])


def _bucket(p: PhraseParams):
    """Totals of one hash bucket's n-grams that reach `least`: duckdb streams the bucket, and spills what doesn't fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="phrases-")
        con = duckdb.connect(config={"memory_limit": f"{p.duckdb_mb}MB", "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            con.register("grams", pa.RecordBatchReader.from_batches(_GRAMS, (b.cast(_GRAMS) for b in batches)))
            totals = con.execute(f"SELECT lang, words, gram, sum(m)::BIGINT AS f FROM grams GROUP BY lang, words, gram HAVING sum(m) >= {p.least}")
            for b in totals.to_arrow_reader(50_000) if hasattr(totals, "to_arrow_reader") else totals.fetch_record_batch(50_000):
                yield pa.RecordBatch.from_arrays([b["lang"].cast(pa.string()), b["words"], b["gram"].cast(pa.string()), b["f"]], names=["lang", "words", "gram", "f"])
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    langs = batch["lang"].dictionary_encode()
    salt = _lang_hash(langs.dictionary.to_pylist())[langs.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
    for i, j, data, offs in K.slices(batch["gram"]):
        yield K.byte_sums(data, 0).of(offs[:-1], offs[1:]) ^ salt[i:j]


def frequent(cut: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, words, gram, f): n-grams of up to `longest` words that occur at least `least` times in the pieces (lang, piece, words, m).

    Words are counted first, then pairs of frequent words, then longer ones of frequent pairs: a filter of bounded size tells which these
    are, so that most n-grams that can't be frequent are never shuffled. Each task sums its slices' n-grams, which are then dealt to buckets by
    hash, so a very common one is a row for each slice.
    """
    spark, out = cut.sparkSession, None
    shared, of = None, 1
    for sizes in (range(1, 2), range(2, 3), range(3, params.longest + 1)):
        if sizes and sizes.stop <= params.longest + 1:
            dealt = cut.mapInArrow(_grams(params, sizes, shared, of), "lang string, words int, gram string, m long").repartition("lang", "gram")
            found = land(dealt.mapInArrow(_bucket(params), "lang string, words int, gram string, f long"), "grams")
            out = found if out is None else out.union(found)
            of = sizes.start
            if sizes.stop <= params.longest:
                shared = spark.sparkContext.broadcast(bloom.built(found, _hashes, bloom.log2_for(found.count(), params.filter_bits, params.filter_log2_most)))
    return out


def _part(first: F.Column, n: F.Column) -> F.Column:
    return F.array_join(F.slice(F.split("gram", " "), first, n), " ")


def scored(counts: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, gram, words, a, l, r, score) of the candidates among counts (lang, words, gram, f): the lowest-scoring cut of each, ties to the
    first. Each cut asks for the counts of its two parts; requests and counts meet by a shuffle on the part."""
    wide = F.lit(params.scale).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")
    many = counts.where("words >= 2").select("lang", "gram", "words", F.col("f").alias("a"))
    k = F.col("k")
    sides = F.array(F.struct(F.lit("l").alias("side"), _part(F.lit(1), k).alias("part")), F.struct(F.lit("r").alias("side"), _part(k + 1, F.col("words") - k).alias("part")))
    asks = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("ask", F.explode(sides)).select("lang", "gram", "words", "a", "k", "ask.*")
    told = asks.join(counts.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"])
    cuts = range(1, params.longest)
    of = lambda side, c: F.max(F.when((F.col("side") == side) & (k == c), F.col("f"))).alias(f"{side}{c}")
    each = told.groupBy("lang", "gram", "words", "a").agg(*(of(side, c) for c in cuts for side in "lr"))
    each = each.withColumn("wide", wide)
    # whole numbers throughout: div of decimals of 38 digits
    cut = lambda c: F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(f"wide div (cast(l{c} as decimal(20,0)) + cast(r{c} as decimal(20,0)))").alias("score"), F.lit(c).alias("k"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
    least = cut(1) if len(cuts) == 1 else F.array_min(F.array(*map(cut, cuts)))
    return each.withColumn("best", least).select("lang", "gram", "words", "a", "best.l", "best.r", "best.score")


def phrases(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """The `top` phrases of each lang of docs (text, lang) by score, then occurrences, then phrase in UTF-8 order: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z in lower case, are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`. a, l and r are occurrences
    of the phrase and of its two parts where the cut scores least, n the words of the lang. Phrases inside a longer candidate with
    `percent` of their occurrences are dropped. A null lang is `unknown`; null and empty texts have no words; rows repeated in full count
    each; other columns are ignored; an empty table gives an empty result. A text has to fit in a task.
    """
    cut = land(pieces(docs, params), "pieces")
    totals = cut.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n"))
    counts = land(frequent(cut, params), "counts")
    inner = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _part(i, n)))
    covered = counts.where("words >= 3").select("lang", F.col("f").alias("longer"), F.explode(F.flatten(inner)).alias("gram")).groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    kept = scored(counts, params).join(covered, ["lang", "gram"], "left").where("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * " + str(params.percent))
    # the first of each part of a lang, then the first of these: however many tasks there are, one lang's last task gets so many parts' first
    best = (F.desc("score"), F.desc("a"), "gram")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(params.parts))).orderBy(*best)
    first = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= params.top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= params.top)
    return first.join(totals, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, words, unnest(list_transform(range(1, len(ws) - words + 2), lambda i: array_to_string(ws[i:i + words - 1], ' '))) AS gram FROM worded, (SELECT unnest([1, 2, 3, 4]) AS words)
), counts AS (
  SELECT lang, words, gram, count(*) AS f, string_split(gram, ' ') AS ws FROM grams GROUP BY lang, words, gram HAVING count(*) >= 30
), cuts AS (
  SELECT lang, gram, f AS a, k, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM counts, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words
), scored AS (
  SELECT c.lang, c.gram, a, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM cuts c JOIN counts l ON l.lang = c.lang AND l.gram = lp JOIN counts r ON r.lang = c.lang AND r.gram = rp
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.gram ORDER BY score, k) = 1
), covered AS (
  SELECT lang, gram, max(f) AS longer FROM (SELECT lang, f, unnest(list_transform(range(1, words - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram FROM counts, (SELECT unnest([2, 3]) AS n) WHERE n < words) GROUP BY lang, gram
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score
FROM scored LEFT JOIN covered USING (lang, gram) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
QUALIFY rank <= 2000
"""
