"""op11: against plain counting, and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from quarry.llm import collocations as C
from quarry.llm import queries as Q
from tests.llm.conftest import by_row


def brute(rows, p):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, p.longest + 1) for i in range(len(w) - k + 1))
    many = {g: a for g, a in f.items() if a >= p.least}
    longer = {}
    for (lang, g), a in many.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                key = lang, g[i : i + k]
                longer[key] = max(longer.get(key, 0), a)
    out = {}
    for (lang, g), a in many.items():
        if len(g) < 2 or 100 * longer.get((lang, g), 0) >= p.percent * a:
            continue
        score, _, l, r = min((p.scale * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return [(lang, i + 1, g.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, g, l, r) in enumerate(sorted(x)[: p.top])]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = "un deux trois été SIX sept x y ß".split(" ")
    out = [(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) + rng.choice(". ; ! \n \r \x0b , ".split(" ")) + "The  quick\tbrown fox", rng.choice(["fr", "de", None, "und", ""])) for _ in range(120)]
    out += [("again " * 400, "fr"), ("a b. " * 90 + "a b c. " * 20, "en"), (None, "en"), ("", None), (" \t.;", "xx"), ("one piece of very many words " * 300, "long")]
    return out + [("the same row", "de")] * 35 + [("of the same row", "de")] * 28


@pytest.mark.parametrize("params", [C.PhraseParams(least=5), C.PhraseParams(least=1, top=40), C.PhraseParams(least=9, longest=2), C.PhraseParams(least=4, longest=3, percent=50), C.PhraseParams(least=3, slice_bytes=200, duckdb_mb=20), C.PhraseParams(least=2, longest=5, filter_log2_most=6)])
def test_plain_counting(spark, rows, params):
    """Ties, repeated rows, overlaps of a repeated word, null and blank texts, langs that meet in `und`, clashing columns; slices of any
    size and filters that let everything through give the same."""
    df = spark.createDataFrame([(t, g, "x", 1) for t, g in rows], "text string, lang string, piece string, m int")
    got = C.phrases(df, params).select(*COLUMNS)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    assert by_row(got.collect()) == by_row(brute(rows, params))


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    big = (1 << 62) + 1
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 4), ("en", 2, "a b", big - 8), ("en", 3, "a b a", 40), ("en", 2, "b a", 41)], "lang string, words int, gram string, f long")
    got = {r["gram"]: (r["l"], r["r"], r["score"]) for r in C.scored(counts).collect()}
    assert got["a b"] == (big, big - 4, 2_000_000 * (big - 8) // (2 * big - 4))
    assert got["a b a"] == (big, 41, 0)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(Q.oracle_sql()["op11_collocations"])
    assert [d[0] for d in want.description] == list(COLUMNS)
    got = Q.queries()["op11_collocations"](spark, sf).select(*COLUMNS).collect()
    assert got and by_row(got) == by_row(want.fetchall())


def test_no_rows(spark):
    assert C.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.phrases(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), C.PhraseParams(least=1)).count() == 0
