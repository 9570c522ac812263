"""Toxicity: a numpy classifier by non-negative positive-unlabelled learning."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import labelled
from quarry.llm.scratch import land


class PUParams(NamedTuple):
    #: toxic rows and unlabelled rows learnt from, at most
    positives: int = 3000
    unlabelled: int = 9000
    #: bytes of a word's beginnings that are features beside the whole word
    heads: tuple[int, ...] = (4, 5, 6)
    log2_space: int = 20
    #: features kept: in this many positives at least, so many times likelier there, the best of them
    least: int = 4
    times: float = 3.0
    most: int = 1024
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 3


class Model(NamedTuple):
    features: np.ndarray  # sorted places in the hashed space
    weights: np.ndarray
    bias: float


def word_features(data: np.ndarray, offs: np.ndarray, p: PUParams) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of each word and its beginnings, in lower case."""
    data = K.lower(data)
    s, e, woffs = K.words(data, offs)
    sums = K.byte_sums(data, 0)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    ends = [e, *(np.minimum(s + h, e) for h in p.heads)]
    at = np.concatenate([(sums.of(s, x) ^ K.seeded(9, 1)[i]) >> np.uint64(64 - p.log2_space) for i, x in enumerate(ends)])
    return at.astype(np.int64), np.tile(text, len(ends))


def distinct(at: np.ndarray, text: np.ndarray, p: PUParams) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text << p.log2_space | at)
    return both & ((1 << p.log2_space) - 1), both >> p.log2_space


def risk(part: np.ndarray, sign: float, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean sigmoid loss of the rows of part if their label were sign, by weights w (the last is the bias), and its gradient."""
    if not len(part):
        return 0.0, np.zeros_like(w)
    loss = 1 / (1 + np.exp(np.clip(sign * (part @ w[:-1].astype(np.float32) + w[-1]), -30, 30)))
    slope = (-sign * loss * (1 - loss) / len(part)).astype(np.float32)
    return float(loss.mean()), np.append(slope @ part, slope.sum())


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, p: PUParams) -> tuple[np.ndarray, float]:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the sigmoid loss, by Adam. Where the estimate of
    the negatives' risk falls below zero, its gradient is followed upwards instead, which stops overfitting."""
    pos, unl = x[positive], x[~positive]
    w = np.zeros(x.shape[1] + 1, np.float64)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)

    for step in range(1, p.steps + 1):
        (_, plus), (minus_p, g_p), (minus_u, g_u) = risk(pos, 1, w), risk(pos, -1, w), risk(unl, -1, w)
        negative = minus_u - prior * minus_p
        g = prior * plus + (g_u - prior * g_p) if negative >= 0 else prior * g_p - g_u
        g[:-1] += p.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def _observed(p: PUParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, row = batch["toxic"].to_numpy(), batch["row"].to_numpy()
            for i, _, data, offs in K.slices(batch["text"]):
                at, text = distinct(*word_features(data, offs, p), p)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(row[i + text]), pa.array(toxic[i + text])], names=["at", "row", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, params: PUParams = PUParams()) -> Model:
    """Train from confirmed toxic rows outside the held-out fold and from texts whose labels aren't looked at.

    The class prior is the share of toxic rows among the labels that may be learnt from. Rows of one doc_id are one example, however
    often it or its label is repeated (its texts are put together); labels that are null, or of no document or no doc_id, are no examples, and a null text has no words. Without
    examples (as for empty tables) the model answers with the prior.
    """
    p = params
    open_ = labels.where(~labelled.held_out())
    prior = open_.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    toxic = labelled.sampled_ids(labels, "toxic", 1, p.positives).withColumn("toxic", F.lit(1))
    other = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~labelled.held_out()).orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.unlabelled).withColumn("toxic", F.lit(0))
    # two orderings of all ids: done once
    ids = land(toxic.union(other), "sample")
    sample = labelled.sampled_texts(docs, ids).select(F.xxhash64("doc_id", "toxic").alias("row"), "toxic", "text").distinct()
    # the texts of one id are one text, so that a feature comes once from each row without a shuffle of features
    sample = land(sample.groupBy("row", "toxic").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")), "texts")
    seen = land(sample.mapInArrow(_observed(p), "at long, row long, toxic int"), "features")
    # rows are those that have a text; ids of labels alone aren't
    found = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = (max(1, found.get(t, 0)) for t in (1, 0))
    df = seen.groupBy("at").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= p.least)
    df = df.withColumn("lift", (F.col("a") / n1) / ((F.col("b") + 1) / n0)).where(F.col("lift") >= p.times)
    kept = np.sort([r["at"] for r in df.orderBy(F.desc(F.col("a") * F.log("lift")), "at").limit(p.most).collect()]).astype(np.int64)
    if prior is None or not len(kept):
        return Model(kept, np.zeros(len(kept)), -4.0 if not prior else float(np.log(prior / max(1e-9, 1 - prior))))
    hits = seen.where(F.col("at").isin(kept.tolist())) if len(kept) <= 64 else seen.join(F.broadcast(docs.sparkSession.createDataFrame([(int(k),) for k in kept], "at long")), "at")
    # texts without any kept feature count too: as rows of zeros
    got = hits.groupBy("row", "toxic").agg(F.collect_list("at").alias("ats")).orderBy("row").collect()
    x = np.zeros((n1 + n0, len(kept)), np.float32)
    positive = np.arange(n1 + n0) < n1
    at = {1: 0, 0: n1}
    for r in got:
        x[at[r["toxic"]], np.searchsorted(kept, r["ats"])] = 1
        at[r["toxic"]] += 1
    w, b = nnpu(x, positive, float(prior), p)
    return Model(kept, w, b)


def probability(model: Model, data: np.ndarray, offs: np.ndarray, p: PUParams) -> np.ndarray:
    texts = len(offs) - 1
    z = np.full(texts, model.bias)
    if len(model.features):
        at, text = word_features(data, offs, p)
        mask = np.zeros(1 << p.log2_space, bool)
        mask[model.features] = True
        hit = mask[at]
        at, text = distinct(at[hit], text[hit], p)
        z += np.bincount(text, model.weights[np.searchsorted(model.features, at)], texts)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, params: PUParams = PUParams(), threshold: float = 0.5) -> DataFrame:
    """docs with two more columns, toxic_score and toxic_predicted (1 from the threshold on). Every word of every text counts.

    A null or empty text has no features and gets the score of the bias; repeated rows get one score. Other columns pass through, but
    those of the two names, which are replaced; an empty table gives an empty result. Nothing is shuffled. A text has to fit in a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for i, j, data, offs in K.slices(batch["text"]):
                got = probability(own, data, offs, params)
                cols = [c.slice(i, j - i) for c in batch.columns] + [pa.array(got), pa.array((got >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "toxic_score", "toxic_predicted"])

    docs = docs.drop("toxic_score", "toxic_predicted")
    return docs.mapInArrow(run, docs.withColumns({"toxic_score": F.lit(0.0), "toxic_predicted": F.lit(0)}).schema)
