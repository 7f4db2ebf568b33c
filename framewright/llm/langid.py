"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows that overlap by MARGIN bytes on both sides and are cut at
character borders; a text of one window is read whole. In a window the network runs
over all bytes in both directions, through spaces and words, and labels every position
with language probabilities from both states. A position counts in the one window in
whose core it stands, and a document's probabilities are the mean of those of all its
positions. Gates and states use x / (1 + |x|) in place of the hyperbolic tangent and
(1 + x / (1 + |x|)) / 2 in place of the logistic function. Training is backpropagation
through time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold
from .words import byte_blocks

#: Units in each direction, bytes of a window's core and of its margins, and the same
#: of the windows in training; windows read at once.
UNITS, CORE, MARGIN, TRAIN_CORE, TRAIN_MARGIN, ROWS = 12, 448, 32, 96, 16, 1024
#: Bound of the labelled sample: documents of each language, whole.
SAMPLE_DOCS = 128
#: The byte after a window's end. Its gate keeps the state as it is.
PAD, SHUT = 256, 1e6


@dataclass
class Model:
    names: list[str]
    weights: dict[str, np.ndarray]


def borders(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Moved back to where a UTF-8 character begins."""
    at = at.copy()
    for _ in range(3):
        inside = np.flatnonzero(at < len(data))
        inside = inside[(data[at[inside]] & 0xC0) == 0x80]
        at[inside] -= 1
    return at


def windows(data: np.ndarray, offsets: np.ndarray, core: int = CORE, margin: int = MARGIN) -> tuple[np.ndarray, ...]:
    """(text number, start, end, core start, core end) of the windows of all texts. A
    text of at most ``core`` and both margins is one window."""
    sizes = np.diff(offsets)
    counts = np.where(sizes <= core + 2 * margin, np.minimum(sizes, 1), -(-sizes // core))
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first, last = offsets[:-1][owner], offsets[1:][owner]
    begin = borders(data, first + place * core)
    end = np.where(place == counts[owner] - 1, last, borders(data, np.minimum(first + (place + 1) * core, last)))
    return owner, np.maximum(first, begin - margin), np.minimum(last, end + margin), begin, end


def window_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of windows, steps x windows; PAD after a window's end."""
    at = start + np.arange(int((end - start).max()))[:, None]
    inside = at < end
    return np.where(inside, data[np.where(inside, at, 0)].astype(np.intp), PAD)


def bend(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def run_direction(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
    """The state (units x windows) after each step; ``table`` is gates x bytes. The gates
    are reset, keep and the new state. ``keep`` takes what training needs."""
    k = len(u) // 3
    h = np.zeros((k, x.shape[1]), table.dtype)
    hidden, inp = np.empty((3 * k, x.shape[1]), table.dtype), np.empty((3 * k, x.shape[1]), table.dtype)
    for t in range(len(x)):
        np.matmul(u, h, out=hidden)
        np.take(table, x[t], axis=1, out=inp, mode="clip")
        gates = inp[: 2 * k]
        gates += hidden[: 2 * k]
        bend(gates)
        gates *= 0.5
        gates += 0.5
        new = hidden[2 * k :].copy() if keep is not None else hidden[2 * k :]
        new *= gates[:k]
        new += inp[2 * k :]
        bend(new)
        if keep is not None:
            keep.append((h.copy(), gates.copy(), new.copy(), hidden[2 * k :].copy()))
        h -= new
        h *= gates[k:]
        h += new
        yield h


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the middle axis (steps x languages x windows), in place."""
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def position_labels(x: np.ndarray, w: dict) -> np.ndarray:
    """Label probabilities of every position: steps x languages x windows."""
    out = np.empty((len(x), len(w["b"]), x.shape[1]), w["b"].dtype)
    for t, h in enumerate(run_direction(x, w["xf"], w["uf"])):
        np.matmul(w["vf"], h, out=out[t])
    for t, h in enumerate(run_direction(x[::-1], w["xb"], w["ub"])):
        out[-1 - t] += w["vb"] @ h
    out += w["b"][:, None]
    return softmax(out)


def initial(names: int, rng: np.random.Generator, kind=np.float32) -> dict[str, np.ndarray]:
    w = {"b": np.zeros(names, kind)}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.5, (3 * UNITS, PAD + 1)).astype(kind)
        w[f"u{side}"] = rng.normal(0, 0.4, (3 * UNITS, UNITS)).astype(kind)
        w[f"v{side}"] = rng.normal(0, 0.4, (names, UNITS)).astype(kind)
    return shut(w)


def shut(w: dict) -> dict:
    for side in "fb":
        w[f"x{side}"][:, PAD] = np.repeat([0, SHUT, 0], UNITS)
    return w


def gradients(x: np.ndarray, labels: np.ndarray, mask: np.ndarray, w: dict) -> tuple[float, dict]:
    """Mean cross-entropy of the positions of ``mask`` (steps x windows), and its slopes
    by backpropagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: [h.copy() for h in run_direction(x if side == "f" else x[::-1], w[f"x{side}"], w[f"u{side}"], kept[side])] for side in "fb"}
    both = {"f": np.stack(states["f"]), "b": np.stack(states["b"][::-1])}
    prob = softmax(w["vf"] @ both["f"] + w["vb"] @ both["b"] + w["b"][:, None])
    scale = 1 / mask.sum()
    right = np.take_along_axis(prob, labels[None, None, :], 1)[:, 0]
    loss = float(-(np.log(np.maximum(right, 1e-30)) * mask).sum() * scale)
    np.put_along_axis(prob, np.broadcast_to(labels[None, None, :], (len(x), 1, len(labels))), right[:, None] - 1, 1)
    prob *= mask[:, None, :] * scale
    g = {"b": prob.sum((0, 2))}
    for side in "fb":
        at = prob if side == "f" else prob[::-1]
        steps = x if side == "f" else x[::-1]
        g[f"v{side}"] = np.tensordot(prob, both[side], ((0, 2), (0, 2)))
        into = w[f"v{side}"].T @ at
        back = np.zeros_like(into[0])
        d_in = np.empty((len(x), 3 * UNITS, x.shape[1]), back.dtype)
        g[f"u{side}"] = np.zeros_like(w[f"u{side}"])
        for t in range(len(x) - 1, -1, -1):
            h, gates, new, inner = kept[side][t]
            r, z = gates[:UNITS], gates[UNITS:]
            back += into[t]
            d_new = back * (1 - z) * (1 - np.abs(new)) ** 2
            slope = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2  # of the gates
            d_r, d_z = d_new * inner * slope[:UNITS], back * (h - new) * slope[UNITS:]
            d_in[t] = np.concatenate([d_r, d_z, d_new])
            d_hidden = np.concatenate([d_r, d_z, d_new * r])
            g[f"u{side}"] += d_hidden @ h.T
            back = back * z + w[f"u{side}"].T @ d_hidden
        flat = steps.ravel()
        g[f"x{side}"] = np.stack([np.bincount(flat, d_in[:, i].ravel(), PAD + 1) for i in range(3 * UNITS)]).astype(back.dtype)
        g[f"x{side}"][:, PAD] = 0
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, names: list[str], epochs: int = 4, rate: float = 0.02, seed: int = 11, batch: int = 192) -> Model:
    """Minimise the cross-entropy of every position's label with Adam, over all windows
    of whole texts. Languages weigh the same."""
    rng = np.random.default_rng(seed)
    w = initial(len(names), rng)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    owner, start, end, begin, stop = windows(data, offsets, TRAIN_CORE, TRAIN_MARGIN)
    if len(names) < 2 or not len(owner):
        return Model(names, w)
    labels = labels[owner]
    bytes_of = np.bincount(labels, stop - begin, len(names))
    share = bytes_of.sum() / len(names) / np.maximum(bytes_of, 1)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    steps = epochs * -(-len(owner) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(owner))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x = window_bytes(data, start[pick], end[pick])
            at = start[pick] + np.arange(len(x))[:, None]
            mask = ((at >= begin[pick]) & (at < stop[pick])) * share[labels[pick]].astype(np.float32)
            _, g = gradients(x, labels[pick], mask, w)
            step += 1
            pace = rate * (1 - (step - 1) / steps)
            for k, grad in g.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                w[k] -= (pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            shut(w)
    return Model(names, w)


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """Mean label probabilities over all positions of each text; zeros without any."""
    found, n = [np.zeros((0, len(model.names)))], len(model.names)
    for data, offsets in byte_blocks(texts):
        docs = len(offsets) - 1
        owner, start, end, begin, stop = windows(data, offsets)
        sums = np.zeros((len(owner), n))
        order = np.argsort(end - start, kind="stable") if n else np.zeros(0, int)
        for i in range(0, len(order), ROWS):
            pick = order[i : i + ROWS]
            labels = position_labels(window_bytes(data, start[pick], end[pick]), model.weights)
            at = start[pick] + np.arange(len(labels))[:, None]
            labels *= ((at >= begin[pick]) & (at < stop[pick]))[:, None, :]
            sums[pick] = labels.sum(0).T
        pooled = np.stack([np.bincount(owner, sums[:, k], docs) for k in range(n)], 1) if n else np.zeros((docs, 0))
        found.append(pooled / np.maximum(np.diff(offsets), 1)[:, None])
    return np.concatenate(found)


def fit(docs: DataFrame, k: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on a bounded sample: at most ``sample_docs`` documents of each language
    (the documented bound), those whose hashed id comes first, all of their text."""
    usable = docs.select(F.col("doc_id").alias("row"), "lang").where("lang is not null and row is not null").where(fold(F.col("row"), k) != held_out)
    chosen = usable.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("row"), "row"))).where(F.col("place") <= sample_docs).select("row", "lang").distinct()
    texts = docs.select(F.col("doc_id").alias("row"), "text").where("text is not null")
    rows = texts.join(F.broadcast(chosen), "row").select("lang", "text").toPandas()
    rows = rows.sort_values(["lang", "text"], kind="stable")
    names = sorted(rows["lang"].unique())
    return train([t.encode() for t in rows["text"]], np.searchsorted(names, rows["lang"].to_numpy()) if names else np.zeros(0, int), names)


def language_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """A struct column ``lang_pred, score`` of the texts of ``docs``."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # under 100 kB at any input size

    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names = np.array([*spread.value.names, "und"], object)
            p = probabilities(texts, spread.value)
            best = p.argmax(1) if p.shape[1] else np.full(len(p), -1)
            score = p.max(1) if p.shape[1] else np.zeros(len(p))
            best = np.where(score > 0, best, len(names) - 1)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["lang", "score"])

    text = F.col(text_col)
    found = F.arrow_udf(language, "lang string, score double")(F.coalesce(text, F.lit("")))
    known = text.isNotNull() & text.rlike(r"\p{L}") & (found["lang"] != "und")
    return F.struct(F.when(known, found["lang"]).otherwise("und").alias("lang_pred"), F.when(known, found["score"]).otherwise(0.0).alias("score"))


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, one row for each input row.

    ``und`` with score 0 for a null text, a text without a letter, or when nothing was
    learned. Ties go to the first language by name. Every byte of a long text counts.
    Repeated rows give repeated results, an empty table an empty one, a null id stays
    null; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), language_column(docs, model, text_col).alias("found"))
    return rows.select("doc_id", "found.lang_pred", "found.score")


def keep_languages(docs: DataFrame, model: Model, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of ``least`` or more:
    rows without text or letters go. Each row is judged by its text alone, so repeated
    rows and those with a null id stay or go alike; columns of any name are kept."""
    columns = docs.columns
    judged = docs.withColumn("_language", language_column(docs, model, text_col))
    return judged.where((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= least)).select(columns)
