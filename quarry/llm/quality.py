"""Quality classifier: a byte-level convolutional network in numpy."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm import labelled


class NetParams(NamedTuple):
    #: numbers for each byte; bytes that a filter sees and by which it moves; filters
    depth: int = 4
    width: int = 16
    step: int = 4
    filters: int = 16
    #: bytes by which chunks begin; a chunk is two of these long, so chunks overlap by half
    half: int = 128
    #: labelled rows learnt from, for each label; their texts are learnt from whole
    sample: int = 1000
    #: steps of training, however many rows there are, and rows in a step
    steps: int = 320
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


class Net(NamedTuple):
    embed: np.ndarray  # (256, depth)
    kernel: np.ndarray  # (width * depth, filters)
    shift: np.ndarray  # (filters,)
    dense: np.ndarray  # (2 * filters,)
    bias: np.ndarray  # (1,)


def layout(data: np.ndarray, offs: np.ndarray, p: NetParams) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid in whole halves (two at least), with zeros after them and one more half of zeros, so that no filter sees the next
    text; and where each text's halves begin."""
    size = np.diff(offs)
    halves = np.maximum(2, -(-size // p.half)) + 1
    begin = np.concatenate(([0], np.cumsum(halves)))
    out = np.zeros(begin[-1] * p.half + p.width, np.uint8)
    for t in range(len(size)):
        out[begin[t] * p.half : begin[t] * p.half + size[t]] = data[offs[t] : offs[t + 1]]
    return out, begin


#: halves whose outputs are held at once, so that a text of any length takes bounded memory
_HALVES = 2048


def activations(net: Net, laid: np.ndarray, p: NetParams) -> np.ndarray:
    """Filter outputs at every step: (steps, filters)."""
    parts = p.width // p.step
    x = net.embed[laid].reshape(-1, p.step * p.depth)
    k = net.kernel.reshape(parts, p.step * p.depth, p.filters).transpose(1, 0, 2).reshape(p.step * p.depth, -1)
    z = x @ k
    n = len(x) - parts
    out = z[:n, : p.filters] + net.shift
    for i in range(1, parts):
        out += z[i : n + i, i * p.filters : (i + 1) * p.filters]
    return out


def pooled(net: Net, laid: np.ndarray, begin: np.ndarray, p: NetParams, where: bool = False):
    """Each overlapping chunk's largest output of each filter, the chunk's text, and with `where` the step it came from."""
    steps = p.half // p.step
    half = np.empty((begin[-1], p.filters), net.kernel.dtype)
    at = np.empty(half.shape if where else (0, 0), np.int64)
    for i in range(0, begin[-1], _HALVES):
        j = min(i + _HALVES, begin[-1])
        acts = activations(net, laid[i * p.half : j * p.half + p.width], p)[: (j - i) * steps].reshape(-1, steps, p.filters)
        half[i:j] = acts.max(axis=1)
        if where:
            at[i:j] = acts.argmax(axis=1) + np.arange(i, j)[:, None] * steps
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin) - 2)
    first = np.arange(len(text)) + 2 * text
    best = np.maximum(np.maximum(half[first], half[first + 1]), 0)
    return best, text, np.where(half[first] >= half[first + 1], at[first], at[first + 1]) if where else None


def features(best: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.searchsorted(text, np.arange(texts))
    mean = np.add.reduceat(best, begin, axis=0) / np.diff(np.append(begin, len(text)))[:, None]
    return np.concatenate((mean, np.maximum.reduceat(best, begin, axis=0)), axis=1), begin


def probability(net: Net, data: np.ndarray, offs: np.ndarray, p: NetParams) -> np.ndarray:
    laid, begin = layout(data, offs, p)
    best, text, _ = pooled(net, laid, begin, p)
    z = features(best, text, len(offs) - 1)[0] @ net.dense + net.bias[0]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def gradients(net: Net, texts: list[bytes], y: np.ndarray, weight: np.ndarray, p: NetParams) -> list[np.ndarray]:
    laid, begin = layout(*_join(texts), p)
    best, text, at = pooled(net, laid, begin, p, where=True)
    f, first = features(best, text, len(texts))
    prob = 1 / (1 + np.exp(-np.clip(f @ net.dense + net.bias[0], -30, 30)))
    g = ((prob - y) * weight / weight.sum()).astype(np.float32)
    back = g[:, None] * net.dense
    chunks = np.diff(np.append(first, len(text)))
    d = back[text, : p.filters] / chunks[text][:, None]
    top = f[:, p.filters :][text] == best
    d += back[text, p.filters :] * top / np.maximum(np.add.reduceat(top.astype(np.float32), first, axis=0)[text], 1)
    d *= best > 0
    # only the step that each filter's largest output came from learns
    kernel, embed = np.zeros_like(net.kernel), np.zeros_like(net.embed)
    for i in range(0, len(at), _HALVES):
        seen = laid[at[i : i + _HALVES, :, None] * p.step + np.arange(p.width)]
        x = net.embed[seen].reshape(*seen.shape[:2], -1)
        kernel += np.einsum("cf,cfk->kf", d[i : i + _HALVES], x)
        to_x = (d[i : i + _HALVES, :, None] * net.kernel.T[None]).reshape(-1, p.depth)
        embed += np.stack([np.bincount(seen.reshape(-1), to_x[:, c], 256) for c in range(p.depth)], axis=1).astype(embed.dtype)
    return [embed, kernel, d.sum(axis=0), g @ f, g.sum(keepdims=True)]


def train(good: list[bytes], bad: list[bytes], p: NetParams) -> Net:
    """Fit by Adam. Without examples of one label the network answers with the share of the other's."""
    rng = np.random.default_rng(p.seed)
    w = p.width * p.depth
    net = Net(rng.normal(0, 0.5, (256, p.depth)), rng.normal(0, (2 / w) ** 0.5, (w, p.filters)), np.zeros(p.filters), rng.normal(0, 0.1, 2 * p.filters), np.zeros(1))
    net = Net(*(a.astype(np.float32) for a in net))
    if not good or not bad:
        return net._replace(dense=net.dense * 0, bias=np.array([(bool(good) - bool(bad)) * 4.0], np.float32))
    texts = [*good, *bad]
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    weight = np.where(y == 1, len(texts) / 2 / len(good), len(texts) / 2 / len(bad))
    m, v = [np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net]
    order = np.zeros(0, np.int64)
    for step in range(1, p.steps + 1):
        while len(order) < p.batch:
            order = np.concatenate((order, rng.permutation(len(texts))))
        pick, order = order[: p.batch], order[p.batch :]
        rate = p.rate * (1 - step / (p.steps + 1))
        moved = []
        for k, g in enumerate(gradients(net, [texts[j] for j in pick], y[pick], weight[pick], p)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            moved.append((net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        net = Net(*moved)
    return net


def _trained(p: NetParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["value"], r["doc_id"], r["b"]) for batch in batches for r in batch.to_pylist())
        net = train(*([b for v, _, b in rows if v == value] for value in (1, 0)), p)
        yield pa.RecordBatch.from_pydict({"part": pa.array([a.astype(np.float32).tobytes() for a in net], pa.binary()), "at": pa.array(range(len(net)), pa.int32())})

    return run


def fit(docs: DataFrame, labels: DataFrame, params: NetParams = NetParams()) -> Net:
    """Train, in one task, from the whole texts of at most 2 * sample labelled rows outside the held-out fold; only the network comes to the driver.

    Rows repeated in docs are learnt from as often; labels repeated count once; labels that are null, or of no document or no doc_id, are
    passed over. A null text is learnt from as an empty one. Without rows of one label (as for empty tables) the network
    answers with the other's.
    """
    p = params
    ids = [labelled.sampled_ids(labels, "quality", value, p.sample).withColumn("value", F.lit(value)) for value in (1, 0)]
    rows = labelled.sampled_texts(docs, ids[0].union(ids[1])).select("value", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("b"))
    parts = sorted(rows.repartition(1).mapInArrow(_trained(p), "part binary, at int").collect(), key=lambda r: r["at"])
    if not parts:  # Spark runs no task for a table that it knows to be empty
        return train([], [], p)
    shapes = ((256, p.depth), (p.width * p.depth, p.filters), (p.filters,), (2 * p.filters,), (1,))
    return Net(*(np.frombuffer(bytes(r["part"]), np.float32).reshape(shape) for r, shape in zip(parts, shapes, strict=True)))


def score(docs: DataFrame, net: Net, params: NetParams = NetParams(), threshold: float = 0.3) -> DataFrame:
    """docs with two more columns, quality_score and quality_predicted (1 from the threshold on). Every byte of every text counts.

    A null or empty text is scored as a chunk of zeros, and repeated rows get one score. Other columns pass through, but those of the two
    names, which are replaced; an empty table gives an empty result. Nothing is shuffled. A text has to fit in a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Net(*shared.value)
        for batch in batches:
            for i, j, data, offs in K.slices(batch["text"], 1 << 18):
                got = probability(model, data, offs, params)
                cols = [c.slice(i, j - i) for c in batch.columns] + [pa.array(got), pa.array((got >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "quality_score", "quality_predicted"])

    docs = docs.drop("quality_score", "quality_predicted")
    return docs.mapInArrow(run, docs.withColumns({"quality_score": F.lit(0.0), "quality_predicted": F.lit(0)}).schema)
