"""op12: ids against the tiktoken library, pieces against the pattern, and round trips."""

import hashlib

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as P
from quarry.llm import bpe
from quarry.llm import queries as Q

PATH = P.path("byte_bpe_50k.tiktoken")
PARAMS = bpe.BpeParams(PATH)


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def own_ids(texts):
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    bounds = bpe.pieces(data, offs)
    ids, count = bpe._Cache(PARAMS).of(data.tobytes(), bounds)
    tokens = np.concatenate(([0], np.cumsum(count)))
    at = tokens[np.searchsorted(bounds, offs)] if len(data) else [0] * len(offs)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("'stmdrevlaB 1٣\n\t\u00a0.!é漢🙂\u0301")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=12))
def test_ids_of_any_text(lib, texts):
    assert own_ids(texts) == [lib.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["don't we'll I've 'sx ''s  's \n's x's's 're're", "a" * 4000, " " * 700, "ab" * 900, "<|endoftext|>", "'", "'l", "x'll", "é" * 70, "\u2028 a", "1've 2 's3"])
def test_hard_texts(lib, text):
    assert own_ids([text, text]) == [lib.encode_ordinary(text)] * 2


def test_blocks_agree_with_the_pattern():
    """Pieces of texts that fill many blocks of the scan."""
    text = "I'm here,  don't\n\nyou? 12 345é..  \t x " * 400
    bounds = bpe.pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    raw = text.encode()
    assert [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])] == regex.findall(P.PATTERN, text)  # noqa: B905


def test_small_ranks_merge_the_leftmost_least_pair():
    rank = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"aa": 258, b"abc": 300, b"whole": 301}
    assert bpe.merged(b"abc", rank) == [300] and bpe.merged(b"aaa", rank) == [258, 97] and bpe.merged(b"whole", rank) == [301]
    assert bpe.merged(b"aabc", rank) == [97, 300] and bpe.merged(b"cba", rank) == [99, 98, 97]


def test_query(spark, lib, docs, texts):
    """Null, empty, blank, long and repeated rows; clashing columns are left behind."""
    rows = bpe.encoded(docs, PARAMS).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], tuple(r["ids"])) for r in rows) == sorted((i or -1, len(e := lib.encode_ordinary(t or "")), tuple(e)) for i, t in texts)
    for r in rows:
        raw = [lib.decode_single_token_bytes(i) for i in r["ids"]]
        assert r["ends"] == np.cumsum([len(x) for x in raw]).tolist()
    back = bpe.decoded(bpe.encoded(docs, PARAMS), PARAMS)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in texts)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, PARAMS).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i or -1, len(e := lib.encode_ordinary(t or "")), sha(np.array(e, "<u4").tobytes()), sha((t or "").encode())) for i, t in texts)
    assert got == want
    assert bpe.digests(docs.limit(0), PARAMS).count() == 0


def test_text_above_a_slice(spark, lib):
    text = "one's word and 1,2 more \u00e9 " * 60_000 + "z" * 3000
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df, PARAMS).collect()}
    assert len(text.encode()) > 1 << 20
    assert got == {1: lib.encode_ordinary(text), 2: lib.encode_ordinary("short"), 3: []}


def test_decoded_keeps_columns(spark):
    t = spark.createDataFrame([("a", [1, 2], b"old"), ("b", [], b""), (None, None, None)], "name string, ids array<int>, bytes binary")
    have = {v: k for k, v in bpe.ranks(PATH).items()}
    assert [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in bpe.decoded(t, PARAMS).collect()] == [("a", [1, 2], have[1] + have[2]), ("b", [], b""), (None, None, b"")]


def test_registered(spark):
    df = Q.queries()["op12_byte_bpe"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and df.count() == 200
