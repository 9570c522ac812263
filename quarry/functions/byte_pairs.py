"""Byte-pair tokens by a rank table of the caller's: counts, ids, and cutting to a budget, in Arrow batches."""

import base64
import heapq
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

MARKER = "… [truncated]"


@dataclass(frozen=True)
class Ranks:
    """A file with a line for each token (its bytes in base64, and its rank), and the pattern whose matches are merged each by itself. Tasks read the
    file, so it has to be where they can."""

    path: str
    pattern: str


@lru_cache(maxsize=4)
def table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all neighbours that together are a token, those of the least rank (the leftmost of these) become one, until none are. A piece of n
    bytes takes time in proportion to n log n."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each place; end 0: no part begins there

    def pair(i: int) -> int | None:
        return rank.get(piece[i : end[end[i]]]) if end[i] < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, until = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != until:  # one of the two has changed since
            continue
        end[i], end[j] = until, 0
        if until < n:
            prev[until] = i
            if (r := pair(i)) is not None:
                heapq.heappush(heap, (r, i, end[until]))
        if (h := prev[i]) >= 0 and (r := pair(h)) is not None:
            heapq.heappush(heap, (r, h, until))
    ids, i = [], 0
    while i < n:
        ids.append(rank[piece[i : end[i]]])
        i = end[i]
    return ids


@lru_cache(maxsize=4)
def encoder(ranks: Ranks) -> Callable[[str], list[int]]:
    """text -> ids; what pieces become is remembered, up to 200,000 of them."""
    rank, find = table(ranks.path), regex.compile(ranks.pattern).findall
    of = lru_cache(maxsize=200_000)(lambda piece: tuple(merged(piece.encode(), rank)))
    return lambda text: [i for piece in find(text) for i in of(piece)]


@lru_cache(maxsize=4)
def words(path: str) -> dict[int, bytes]:
    return {r: token for token, r in table(path).items()}


def decoded(ids: list[int], ranks: Ranks) -> bytes:
    word = words(ranks.path)
    return b"".join(word[i] for i in ids)


def cut(text: str, budget: int, ranks: Ranks) -> str:
    """text if it has up to `budget` tokens, else its longest beginning at a token's end that leaves room for the marker, without white space at its end, and
    the marker. What comes back never has more than budget tokens, unless the marker alone has."""
    encode = encoder(ranks)
    if budget <= 0:
        return MARKER
    ids = encode(text)
    if len(ids) <= budget:
        return text
    keep = max(0, budget - len(encode(MARKER)))
    while True:
        out = decoded(ids[:keep], ranks).decode("utf-8", "ignore").rstrip() + MARKER
        if not keep or len(encode(out)) <= budget:
            return out
        keep -= 1


def token_ids(text: Column, ranks: Ranks) -> Column:
    """Ids of a text; none for null and empty ones."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        encode = encoder(ranks)
        return texts.map(lambda t: encode(t) if t else [])

    return run(text)


def token_count(text: Column, ranks: Ranks) -> Column:
    """Tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf(IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        encode = encoder(ranks)
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return run(text)


def truncated(text: Column, budget: int, ranks: Ranks) -> Column:
    """cut() of a text; null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t, budget, ranks))

    return run(text)
