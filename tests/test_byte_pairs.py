"""Byte-pair tokens: against a plain merge loop and a library of the same ranks, with round trips and budgets."""

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import byte_pairs as B

RANKS = B.Ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("'stmdrevl aB1\n.é漢🙂")), st.characters(exclude_categories=["Cs"])), max_size=60)


def plain(piece, rank):
    """The merge loop as it is told: one merge at a time."""
    if piece in rank:
        return [rank[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]  # noqa: B905
        if not pairs:
            return [rank[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40) | TEXT.filter(bool).map(str.encode))
def test_merges(piece):
    rank = B.table(RANKS.path)
    ids = B.merged(piece, rank)
    assert ids == plain(piece, rank) and B.decoded(ids, RANKS) == piece


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(0, 20))
def test_texts_and_budgets(text, budget):
    lib = tiktoken.Encoding("own", pat_str=RANKS.pattern, mergeable_ranks=B.table(RANKS.path), special_tokens={})
    ids = B.encoder(RANKS)(text)
    known = all(len(lib.encode_ordinary(c)) == len(B.encoder(RANKS)(c)) for c in text)
    assert B.decoded(ids, RANKS).decode() == text
    if known and text.isascii():
        assert ids == lib.encode_ordinary(text)
    short, marker = B.cut(text, budget, RANKS), len(B.encoder(RANKS)(B.MARKER))
    assert len(B.encoder(RANKS)(short)) <= max(budget, marker)
    if 0 < budget and len(ids) <= budget:
        assert short == text
    else:
        assert short.endswith(B.MARKER) and text.startswith(short.removesuffix(B.MARKER))


def test_columns(spark):
    rows = [(1, "one two, three é " * 40), (2, ""), (3, None), (4, "short"), (5, "a" * 3000)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in df.select("id", B.token_ids(F.col("text"), RANKS).alias("ids"), B.token_count(F.col("text"), RANKS).alias("n"), B.truncated(F.col("text"), 12, RANKS).alias("cut")).collect()}
    encode = B.encoder(RANKS)
    for i, t in rows:
        assert got[i]["ids"] == (encode(t) if t else []) and got[i]["n"] == len(got[i]["ids"])
    assert got[3]["cut"] is None and got[4]["cut"] == "short" and got[2]["cut"] == "" and got[1]["cut"].startswith("one two, three") and len(encode(got[1]["cut"])) <= 12


@pytest.mark.parametrize("budget", [0, 1, 3, 4, 5, 9])
def test_small_budgets(budget):
    assert B.cut("words " * 50, budget, RANKS).endswith(B.MARKER)
