"""Spelling variants: words one edit apart, found by full neighbourhood generation and a hash join."""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bloom
from quarry.llm import kernels as K
from quarry.llm.scratch import land


class VariantParams(NamedTuple):
    #: code points and occurrences from which a word counts
    shortest: int = 7
    least: int = 2
    #: a form has so many times the occurrences of the word
    times: int = 10
    #: one run in so many, by its hash, loses a code point; 0: none
    damaged: int = 31
    #: bits for each word in the filter that spares neighbours, and the log2 of its greatest size: 2**29 bits are 64 MB
    filter_bits: int = 64
    filter_log2_most: int = 29
    #: words whose neighbourhoods are generated in one task
    task_words: int = 10_000


#: a run of the letters A-Z, a-z and U+00C0 to U+00FF, in UTF-8, of text whose A-Z are lower-cased
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: texts are counted together until their runs have so many different words
_WORDS = 200_000


def _counted(p: VariantParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
            n.clear()
            return out

        for batch in batches:
            raw = K.as_bytes(batch["text"])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), raw, strict=True):
                own = Counter(_RUN.findall(text.as_py().lower()))
                if p.damaged:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word in [w for w in own if zlib.crc32(w, start) % p.damaged == 0]:
                        letters = word.decode()
                        at = zlib.crc32(word, start) % len(letters)
                        n[(letters[:at] + letters[at + 1 :]).encode()] += own.pop(word)
                n.update(own)
                if len(n) > _WORDS:
                    yield told()
        if n:
            yield told()

    return run


def words(docs: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """(word, n) of all texts of docs (doc_id, text): runs of Latin letters, A-Z in lower case, those of `shortest` code points and `least`
    occurrences on. Of runs whose hash (crc32 of id, colon and run) divides by `damaged` one code point goes first. A null or empty text
    has none, a null id hashes as an empty one, rows repeated in full count each, and other columns are ignored. Texts may be of any length
    that a task holds. Each task counts before it shuffles, so a word in a third of all rows is a row for each task."""
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted(params), "word string, n long")
    return seen.where(F.length("word") >= params.shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(n - 1, _STEP), out=out[1:])
    return out


def _hashes(letters: np.ndarray) -> np.ndarray:
    """A polynomial over each row's code points, as it is before its bits are spread. It chooses places in the filter only."""
    return (letters.astype(np.uint64) * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their code points as a matrix) of the words of each length."""
    text = words.to_pylist()
    size = np.array([len(t) for t in text])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, np.frombuffer("".join(text[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n)


def _word_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, letters in _by_length(batch["word"]):
        yield _hashes(letters)


def neighbours(letters: np.ndarray, alphabet: np.ndarray, shortest: int, bits: np.ndarray, log2: int) -> Iterator[tuple[int, str]]:
    """(row, neighbour): all strings one deletion, replacement or insertion over the alphabet away from the words (rows of code points),
    those of `shortest` code points on that the filter lets through. One that comes about in several ways can be told several times."""
    n = letters.shape[1]
    power = _powers(n + 1)
    terms = letters.astype(np.uint64) * power[:n]
    before = np.concatenate((np.zeros((len(letters), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    whole, a = before[:, -1], alphabet.astype(np.uint64)
    text = ["".join(map(chr, w)) for w in letters.tolist()]
    if n - 1 >= shortest:
        # what follows the deleted code point moves one place down: to the terms' ring inverse of the step
        down = _INVERSE
        h = before[:, :-1] + (whole[:, None] - before[:, 1:]) * down
        for i in bloom.passing(h, bits, log2).tolist():
            row, at = divmod(i, n)
            yield row, text[row][:at] + text[row][at + 1 :]
    if n >= shortest:
        h = (whole[:, None, None] - terms[:, :, None]) + a[None, None, :] * power[None, :n, None]
        for i in bloom.passing(h, bits, log2).tolist():
            rest, c = divmod(i, len(a))
            row, at = divmod(rest, n)
            if letters[row, at] != alphabet[c]:
                yield row, text[row][:at] + chr(alphabet[c]) + text[row][at + 1 :]
    if n + 1 >= shortest:
        moved = before + (whole[:, None] - before) * _STEP
        h = moved[:, :, None] + a[None, None, :] * power[None, :, None]
        for i in bloom.passing(h, bits, log2).tolist():
            rest, c = divmod(i, len(a))
            row, at = divmod(rest, n + 1)
            yield row, text[row][:at] + chr(alphabet[c]) + text[row][at:]


_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
#: neighbours hashed at once
_AT_ONCE = 2_000_000


def _generated(shared, alphabet: list[int], p: VariantParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, log2), a = shared.value, np.array(alphabet, np.uint32)
        for batch in batches:
            for rows, letters in _by_length(batch["word"]):
                step = max(1, _AT_ONCE // ((letters.shape[1] + 1) * max(1, len(a))))
                for i in range(0, len(rows), step):
                    found = sorted(set(neighbours(letters[i : i + step], a, p.shortest, bits, log2)))
                    own = rows[i + np.array([f[0] for f in found], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.string()), batch["word"].take(pa.array(own)), batch["n"].take(pa.array(own))], names=["near", "word", "n"])

    return run


def near_words(vocabulary: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """(word, n, near, near_n): each word of vocabulary (word, n; distinct words) with each other word exactly one inserted, deleted or
    replaced code point away. All distinct edits over the alphabet of the vocabulary are generated and joined by equality to the
    vocabulary, so no distance is computed. The alphabet has no more letters than there are code points in the runs (90)."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''")
    alphabet = sorted(ord(r["c"]) for r in letters.collect())
    n = vocabulary.count()
    log2 = bloom.log2_for(n, params.filter_bits, params.filter_log2_most)
    shared = vocabulary.sparkSession.sparkContext.broadcast(bloom.built(vocabulary.select("word"), _word_hashes, log2))
    dealt = vocabulary.select("word", "n").repartition(max(1, -(-n // params.task_words)))
    edits = dealt.mapInArrow(_generated(shared, alphabet, params), "near string, word string, n long")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return edits.join(known, "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form). Every step has at least `times` (2 or more) times the occurrences, a 64-bit number, so chains are
    of bounded length (below 64), and pointers that double their reach end in a few rounds."""
    to = land(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = land(to.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = step.select("word", "root")
        if step.where("moved").isEmpty():
            return to


def variants(docs: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """One row for each word of docs (doc_id, text; see words): word, n, n_near (words one edit away), form, form_n, root.

    The form is the near word of the largest n (ties: the smallest in code-point order), if that has at least `times` times the word's
    occurrences, else null. The root is where forms lead to, the word itself if it has none. A table without words gives an empty result.
    """
    if params.times < 2:
        raise ValueError("forms need at least twice the occurrences, else they could go in a circle")
    vocabulary = land(words(docs, params), "words")
    best = F.min_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_words(vocabulary, params).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b")).select("word", "n", "n_near", "b.*")
    wins = F.col("form_n") >= F.col("n") * params.times
    near = land(near.select("word", "n_near", F.when(wins, F.col("form")).alias("form"), F.when(wins, F.col("form_n")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null"))
    joined = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
