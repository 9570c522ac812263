import hashlib
import random

import pytest


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): ordinary texts, copies, near copies, a shared passage, one word over and over, blanks and nulls."""
    rng = random.Random(5)
    pool = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tré") for b in ("na", "ru", "ße") for c in ("x", "t", "", "q")]
    passage = words(rng, 90, pool)
    base = words(rng, 200, pool)
    rows = [(i, words(rng, rng.randint(5, 250), pool)) for i in range(20)]
    rows += [(20, base), (21, base), (22, base + " more"), (23, base.replace("kanax", "KANAX")), (24, " ".join(base.split()[:170]) + " " + words(rng, 30, pool))]
    rows += [(30 + i, words(rng, 40, pool) + f"  \n{passage}\t" + words(rng, 30, pool)) for i in range(6)]
    rows += [(40, "again " * 300), (41, "again " * 280 + passage), (42, "a" * 3000), (43, "a" * 900 + "b" + "a" * 900), (44, "ab" * 700)]
    rows += [(50, ""), (51, None), (52, " \n\t "), (53, "one"), (54, "two words"), (55, "\x0b\x0c non breaking space   wide")]
    rows += [(60, words(rng, 6000, pool)), (61, base), (61, base), (None, base), (None, "nameless " + passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table, with columns whose names the operators use inside."""
    rows = [(i, t, None if n % 7 == 0 else "en", f"s{n % 4}" if n % 5 else None, len(t or ""), "x", 1, 2.0) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, marks string, tx int, score double")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def by_row(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(type(x)), 0 if x is None else x) for x in r])
