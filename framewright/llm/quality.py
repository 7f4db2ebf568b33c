"""A byte-level convolutional quality classifier in numpy.

Learned filters slide over overlapping chunks that cover the whole document; their
responses are max-pooled in each chunk, a small dense layer gives the chunk's logit,
and a logistic combination of the chunks' logits gives the document's probability.
Convolution over bytes is a sum of table rows, so inference is gathers and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_or_empty
from .words import byte_blocks

CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 256, 224, 6, 16, 16
PAD = 256
#: Bound of the labelled sample: documents of each label, all of their text. Filters and
#: combination are fitted on all chunks of these documents.
SAMPLE_DOCS = 500


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 257 x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    combine: np.ndarray  # of mean, highest, lowest chunk logit and 1
    prior: float | None = None  # the answer to everything, if one label only was seen


def chunk_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, start) of the chunks that cover documents of these lengths."""
    counts = 1 + np.maximum(0, -(-(lengths - CHUNK) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), counts)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE


def chunk_matrix(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = (offsets[owner] + start)[:, None] + np.arange(CHUNK)
    inside = at < offsets[owner + 1][:, None]
    padded = np.append(data, np.uint8(0)).astype(np.int16)
    return np.where(inside, padded[np.where(inside, at, len(data))], PAD)


def pooled(chunks: np.ndarray, model: Model, positions: bool = False):
    """The highest response of each filter in each chunk, and where it is."""
    span = CHUNK - WIDTH + 1
    total = model.tables[0].take(chunks[:, :span], axis=0)
    for j in range(1, WIDTH):
        total += model.tables[j].take(chunks[:, j : j + span], axis=0)
    if positions:
        at = total.argmax(1)
        return np.take_along_axis(total, at[:, None, :], 1)[:, 0] + model.bias, at
    return total.max(1) + model.bias


def chunk_logits(chunks: np.ndarray, model: Model, block: int = 48) -> np.ndarray:
    out = np.empty(len(chunks), np.float32)
    for i in range(0, len(chunks), block):
        top = np.maximum(pooled(chunks[i : i + block], model), 0)
        out[i : i + block] = np.maximum(top @ model.w1 + model.b1, 0) @ model.w2 + model.b2
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def combined(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean, highest and lowest chunk logit of each of ``n`` documents, and 1."""
    first = np.searchsorted(owner, np.arange(n))
    counts = np.bincount(owner, minlength=n)
    return np.stack([np.bincount(owner, logits, n) / counts, np.maximum.reduceat(logits, first), np.minimum.reduceat(logits, first), np.ones(n)], 1)


def text_features(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """What :func:`combined` says of every chunk of each text."""
    owner, start = chunk_starts(np.diff(offsets))
    logits = np.concatenate([chunk_logits(chunk_matrix(data, offsets, owner[i : i + 2048], start[i : i + 2048]), model) for i in range(0, len(owner), 2048)])
    return combined(logits, owner, len(offsets) - 1)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each whole text; nulls count as empty."""
    found = []
    for data, offsets in byte_blocks(texts):
        n = len(offsets) - 1
        if model.prior is not None:
            found.append(np.full(n, model.prior))
            continue
        found.append(sigmoid(text_features(data, offsets, model) @ model.combine))
    return np.concatenate(found) if found else np.zeros(0)


def initial(rng: np.random.Generator, kind=np.float32) -> dict[str, np.ndarray]:
    p = {"tables": rng.normal(0, 0.15, (WIDTH, 257, FILTERS)), "bias": np.zeros(FILTERS), "w1": rng.normal(0, 0.35, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.35, HIDDEN), "b2": np.zeros(1)}
    return {k: v.astype(kind) for k, v in p.items()}


def model_of(p: dict) -> Model:
    return Model(p["tables"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]), np.array([1.0, 0, 0, 0]))


def gradients(chunks: np.ndarray, target: np.ndarray, weight: np.ndarray, p: dict) -> tuple[float, dict]:
    """Weighted mean cross-entropy of these chunks, and its slopes."""
    raw, at = pooled(chunks, model_of(p), positions=True)
    top = np.maximum(raw, 0)
    inner = top @ p["w1"] + p["b1"]
    dense = np.maximum(inner, 0)
    out = sigmoid(dense @ p["w2"] + p["b2"][0])
    loss = float(-(weight * np.log(np.maximum(np.where(target == 1, out, 1 - out), 1e-30))).mean())
    out = (out - target) * weight / len(chunks)
    back = np.outer(out, p["w2"]) * (inner > 0)
    into = (back @ p["w1"].T) * (raw > 0)
    grads = {"w2": dense.T @ out, "b2": out.sum(keepdims=True), "w1": top.T @ back, "b1": back.sum(0), "bias": into.sum(0), "tables": np.zeros_like(p["tables"])}
    for j in range(WIDTH):
        seen = np.take_along_axis(chunks, at + j, 1)
        np.add.at(grads["tables"][j], (seen, np.arange(FILTERS)[None, :]), into)
    return loss, grads


def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.004, seed: int = 7) -> Model:
    """Adam on the cross-entropy of chunks; the combination is left at the mean.

    ``owner`` is the ascending document number of each chunk, ``labels`` are by
    document. Both labels weigh the same, and the chunks of a document together as the
    square root of their number, so that long texts do not outweigh the others.
    """
    rng = np.random.default_rng(seed)
    p = initial(rng)
    model = model_of(p)
    if len(labels) == 0 or labels.min() == labels.max():
        model.prior = float(labels[0]) if len(labels) else 0.5
        return model
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    target = labels[owner].astype(np.float32)
    weight = 1 / np.sqrt(np.bincount(owner))[owner]
    sides = np.bincount(labels[owner], weight, 2)
    weight = (weight * len(weight) / 2 / sides[labels[owner]]).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            _, grads = gradients(chunks[rows], target[rows], weight[rows], p)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model_of(p)


def combination(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of mean, highest, lowest chunk logit and 1 by the documents' cross-entropy."""
    scale = np.abs(features).mean(0) + 1e-6
    w = np.zeros(4)
    for _ in range(400):
        out = sigmoid((features / scale) @ w) - labels
        w -= 0.5 * ((features / scale).T @ out / len(labels) + 1e-3 * w)
    return w / scale


def labelled_sample(docs: DataFrame, labels: DataFrame, k: int, remainder: int, most: int = SAMPLE_DOCS) -> DataFrame:
    """``row, label, text`` of at most ``most`` documents of each label, those whose
    hashed id comes first, outside the held-out fold."""
    usable = labels.select(F.col("doc_id").alias("row"), F.col("quality").cast("int").alias("label")).where("row is not null and label in (0, 1)").where(fold(F.col("row"), k) != remainder)
    # two labels: the first of each by hash, kept so by every task
    sides = [usable.where(F.col("label") == label).orderBy(F.xxhash64("row"), "row").limit(most) for label in (0, 1)]
    chosen = sides[0].unionByName(sides[1]).distinct()
    return docs.select(F.col("doc_id").alias("row"), text_or_empty().alias("text")).join(F.broadcast(chosen), "row").select("row", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, k: int = 5, remainder: int = 0, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on a bounded sample: at most ``sample_docs`` documents of each label
    (``sample_docs`` is the documented bound), on all chunks of each."""
    rows = labelled_sample(docs, labels, k, remainder, sample_docs).toPandas().sort_values(["row", "label", "text"], kind="stable")
    by = rows["label"].to_numpy(np.int64)
    data, offsets = next(byte_blocks(pa.array(rows["text"], pa.large_string()), most=1 << 62), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    owner, start = chunk_starts(np.diff(offsets))
    model = train(chunk_matrix(data, offsets, owner, start), owner, by)
    if model.prior is None:
        model.combine = combination(text_features(data, offsets, model), by)
    return model


def quality_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column of the scores of the texts of ``docs``."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # 100 kB at any input size

    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(texts, spread.value), pa.float64())

    return F.arrow_udf(quality, "double")(text_or_empty(text_col))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted``, one row for each input row.

    Null and empty texts are one chunk of padding and get that chunk's score; every
    chunk of a long text counts. Repeated rows give repeated results, an empty table an
    empty one, a null id stays null; other columns are ignored, whatever their names. A
    score equal to the threshold is predicted 1.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), quality_column(docs, model, text_col).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more. Each row is judged by
    its text alone, so repeated rows and those with a null id stay or go alike; columns
    of any name are kept."""
    columns = docs.columns
    return docs.withColumn("_quality", quality_column(docs, model, text_col)).where(F.col("_quality") >= threshold).select(columns)
