"""Classifiers: held-out accuracy, gradients and risks; scores of whole texts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import labelled, quality, toxicity

from .test_repeats import split

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(tables):
    docs, labels = tables
    net = quality.fit(docs, labels)
    got = quality.score(docs, net).join(labels.withColumnRenamed("quality", "y"), "doc_id").where(labelled.held_out()).select("y", "quality_predicted").collect()
    assert sum(r["y"] == r["quality_predicted"] for r in got) >= 0.95 * len(got)
    again = quality.fit(docs, labels)
    assert all((a == b).all() for a, b in zip(net, again))


def test_quality_edges(spark, docs):
    net = quality.train([b"good text here " * 9] * 20, [b"!! ## $$ " * 20] * 20, quality.NetParams(steps=40))
    got = quality.score(docs, net)
    assert got.count() == docs.count() and got.columns[: len(docs.columns)] == docs.columns
    assert got.where("quality_score is null or quality_score < 0 or quality_score > 1").isEmpty()
    assert quality.score(docs.limit(0), net).count() == 0
    one_sided = quality.train([b"x"], [], quality.NetParams())
    assert quality.probability(one_sided, np.zeros(0, np.uint8), np.array([0, 0]), quality.NetParams())[0] > 0.9


def test_quality_counts_every_byte():
    p = quality.NetParams(steps=30)
    net = quality.train([b"plain words only " * 30] * 20, [b"$$$%%%### " * 40] * 20, p)
    head = b"plain words only " * 200
    score = lambda t: quality.probability(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]), p)[0]
    assert score(head + b"$$$%%%### " * 400) < score(head + b"plain words only " * 235)


def test_quality_against_a_plain_convolution(spark, docs, texts):
    """Scores of whole texts, in blocks or not, against loops over filters and chunks."""
    p = quality.NetParams(filters=4, depth=3)
    rng = np.random.default_rng(1)
    net = quality.Net(*(rng.normal(0, 0.5, s).astype(np.float32) for s in ((256, 3), (48, 4), (4,), (8,), (1,))))

    def plain(text):
        b = text + bytes(max(2, -(-len(text) // p.half)) * p.half - len(text) + p.width)
        outs = [[float(np.concatenate([net.embed[c] for c in b[at : at + p.width]]) @ net.kernel[:, f] + net.shift[f]) for f in range(4)] for at in range(0, len(b) - p.width, p.step)]
        steps = p.half // p.step
        chunks = [[max(0.0, *(o[f] for o in outs[k * steps : (k + 2) * steps])) for f in range(4)] for k in range(len(outs) // steps - 1)]
        x = [sum(c[f] for c in chunks) / len(chunks) for f in range(4)] + [max(c[f] for c in chunks) for f in range(4)]
        return 1 / (1 + np.exp(-(np.dot(x, net.dense) + net.bias[0])))

    some = [t for _, t in texts if t is None or len(t) < 1200]
    got = {r["text"]: r["quality_score"] for r in quality.score(docs.where("text is null or length(text) < 1200"), net, p).select("text", "quality_score").collect()}
    for t in set(some):
        assert got[t] == pytest.approx(plain((t or "").encode()), abs=1e-4)
    data = np.frombuffer(max((t for _, t in texts if t), key=len).encode() * 10, np.uint8)
    offs = np.array([0, 100, len(data)])
    whole = quality.probability(net, data, offs, p)
    before, quality._HALVES = quality._HALVES, 7
    assert quality.probability(net, data, offs, p) == pytest.approx(whole, abs=1e-6)
    quality._HALVES = before


def test_toxicity_scores_against_brute_force(spark, docs, texts):
    p = toxicity.PUParams()
    rng = np.random.default_rng(2)
    one = lambda b, i: int((K.byte_sums(np.frombuffer(b, np.uint8), 0).of(np.array([0]), np.array([len(b)]))[0] ^ K.seeded(9, 1)[i]) >> np.uint64(64 - p.log2_space))

    def places(text):
        words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {one(w.encode()[:h], i) for w in words for i, h in enumerate((None, 4, 5, 6))}

    kept = np.array(sorted(set().union(*(places(t) for _, t in texts)))[::3], np.int64)
    model = toxicity.Model(kept, rng.normal(size=len(kept)), -0.3)
    weights = dict(zip(kept.tolist(), model.weights))
    got = {r["text"]: r["toxic_score"] for r in toxicity.score(docs, model).select("text", "toxic_score").collect()}
    for _, t in texts:
        z = -0.3 + sum(weights.get(x, 0.0) for x in places(t))
        assert got[t] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_labels_without_documents_are_no_examples(spark):
    """Of 300 toxic labels 30 have a document: rows of zeros for the others would drown what those teach."""
    d = spark.createDataFrame([(i, f"vile words here {i}" if i % 10 == 0 else f"kind words there {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)] + [(1000 + i, int(i < 270)) for i in range(2700)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.fit(d.union(d), labels)).collect()
    assert all(r["toxic_predicted"] == (r["doc_id"] % 10 == 0) for r in got)


def test_gradients_match_differences():
    p = quality.NetParams(depth=2, filters=3, half=32)
    rng = np.random.default_rng(0)
    net = quality.Net(*(rng.normal(0, 0.5, s).astype(np.float64) for s in ((256, 2), (32, 3), (3,), (6,), (1,))))
    texts, y, w = [b"some text of a length", b"other text " * 9], np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss(n):
        q = quality.probability(n, *quality._join(texts), p)
        return float((w * -(y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / w.sum())

    for k, g in enumerate(quality.gradients(net, texts, y, w, p)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        moved = []
        for d in (1e-5, -1e-5):
            parts = [a.copy() for a in net]
            parts[k][at] += d
            moved.append(loss(quality.Net(*parts)))
        assert g[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=0.02)


def test_toxicity_held_out(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where(labelled.held_out()).select("y", "toxic_predicted").collect()
    clean = [r for r in got if not r["y"]]
    assert sum(r["y"] == r["toxic_predicted"] for r in got) >= 0.93 * len(got)
    assert sum(r["toxic_predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20)], "doc_id long, toxic int")
    for rows in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.score(docs, toxicity.fit(docs, rows))
        assert got.count() == docs.count() and got.where("toxic_score is null or toxic_score < 0 or toxic_score > 1").isEmpty()
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_negative_risk_is_held_up():
    """With more positives than the prior says, plain unbiased risk would go far below zero."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(1, 1, (200, 5)), rng.normal(1, 1, (50, 5)), rng.normal(-1, 1, (450, 5)))).astype(np.float32)
    w, b = toxicity.nnpu(x, np.arange(700) < 200, 0.1, toxicity.PUParams())
    z = x[200:] @ w + b
    assert (z[:50] > 0).mean() > 0.8 and (z[50:] > 0).mean() < 0.05


def test_fold(spark):
    import zlib

    got = {r["doc_id"]: r["h"] for r in spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", labelled.held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_gradient_of_the_risk_matches_differences():
    rng = np.random.default_rng(8)
    x, w = (rng.random((40, 6)) < 0.4).astype(np.float64), rng.normal(size=7)
    for sign in (1, -1):
        loss = lambda v: float((1 / (1 + np.exp(sign * (x @ v[:-1] + v[-1])))).mean())  # noqa: B023, E731
        value, slope = toxicity.risk(x, sign, w)
        near = [(loss(w + d) - loss(w - d)) / 2e-5 for d in np.eye(7) * 1e-5]
        assert abs(value - loss(w)) < 1e-6 and np.allclose(slope, near, atol=1e-5)
    assert toxicity.risk(x[:0], 1, w)[0] == 0.0
