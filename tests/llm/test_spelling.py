"""op13: against a comparison of all words with all."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import bloom
from quarry.llm import queries as Q
from quarry.llm import spelling as S

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counted(rows, p):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if p.damaged and h % p.damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= p.shortest and c >= p.least}


def brute(rows, p=S.VariantParams()):
    n = counted(rows, p)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= p.times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def got(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_planted_variants(spark):
    """Edits of all three kinds, at both ends and within; chains of forms; ties; letters out of a-z; short words and words told once."""
    word = "straßenköter"
    forms = {word: 1200, "strassenköter": 3, "straßenkoter": 110, "straenköter": 2, "xstraßenköter": 4, "straßenköterx": 120, "straßenkötery": 10, "straßenkötexy": 2, "straßenkoterr": 5}
    forms |= {"ÀÉÎÕÜÿþ".lower(): 2, "ÀÉÎÕÜÿþ": 3, "sevenup": 2, "sevenupp": 20, "sevenups": 20, "sixsix": 50, "sixsixx": 5, "oncesaid": 1, "oncesaidd": 2, "aaaaaaa": 30, "aaaaaaaa": 300, "x×÷×÷×÷": 2}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(forms.items())]
    rows += [(90, None), (91, ""), (None, "nameless nameless, SEVENUP_sevenups1sevenupp"), (92, "twice said"), (92, "twice said"), (93, "Ω" * 9 + " longest" + "t" * 300)]
    plain = S.VariantParams(damaged=0)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert got(S.variants(df, plain)) == brute(rows, plain)
    assert got(S.variants(df)) == brute(rows)
    few = S.VariantParams(damaged=0, shortest=1, least=1, times=2)
    assert got(S.variants(df, few)) == brute(rows, few)
    roots = {w: r for w, *_, r in got(S.variants(df, plain))}
    assert roots["straßenkötexy"] == roots["straßenkötery"] == word or roots["straßenkötery"] == word


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got(Q.queries()["op13_spelling_variants"](spark, SF))
    assert found == brute(rows) and any(f for *_, f, _, _ in found)


def test_filter_of_any_size_gives_the_same(spark, docs, texts):
    full = got(S.variants(docs, S.VariantParams(shortest=3)))
    assert full == brute(texts, S.VariantParams(shortest=3))
    assert got(S.variants(docs, S.VariantParams(shortest=3, filter_log2_most=6))) == full


def test_neighbours_are_all_edits():
    letters, alphabet = np.array([[97, 98, 97]], np.uint32), np.array([97, 98, 255], np.uint32)
    every = np.full(1, ~np.uint64(0))
    own = {x for _, x in S.neighbours(letters, alphabet, 1, every, 6)}
    chars = "abÿ"
    want = {"aba"[:i] + "aba"[i + 1 :] for i in range(3)} | {"aba"[:i] + c + "aba"[i + 1 :] for i in range(3) for c in chars} | {"aba"[:i] + c + "aba"[i:] for i in range(4) for c in chars}
    assert own == want - {"aba"}


def test_hashes_of_neighbours_are_those_of_words():
    """The filter of exactly these words lets each through from its neighbour."""
    letters = np.array([list(map(ord, "abcdéf"))], np.uint32)
    for word in ("abcéf", "bcdéf", "abcdé", "abcdÿf", "xbcdéf", "abcdéx", "abcdéfx", "xabcdéf", "abcxdéf"):
        h = S._hashes(np.array([list(map(ord, word))], np.uint32))
        log2, bits = 20, np.zeros(1 << 14, np.uint64)
        for at in bloom._places(h, log2):
            bits[at >> np.uint64(6)] |= np.uint64(1) << (at & np.uint64(63))
        assert word in {x for _, x in S.neighbours(letters, np.array([ord("x"), 255], np.uint32), 1, bits, log2)}, word


def test_no_words(spark):
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.variants(spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([], "doc_id long, text string"), S.VariantParams(times=1))
