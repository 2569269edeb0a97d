"""Quality classifier: a byte-level convolutional network in numpy.

The whole text is read as UTF-8 bytes and cut into overlapping chunks of ``2 * HALF`` bytes
(hop ``HALF``). Learned byte vectors pass through learned filters of ``WIDTH`` bytes at every
second byte; each filter is max-pooled over a chunk (the maximum of its two halves, so the
overlap costs nothing), a small dense layer turns the pooled filters into a chunk logit, and a
learned combination of the mean, largest and smallest chunk logit gives one probability.

The network is fitted on the driver on at most ``2 * per_class`` labelled documents, of each at
most ``chunks_per_doc`` chunks spread evenly over the document (bounds are parameters of
:func:`train`); scoring covers every byte of every document and needs no shuffle.

Defined results: null text reads as empty text; an empty text is one chunk of padding and gets
the probability the network gives to it. Repeated rows get equal scores. With no labelled rows
of one class (or none at all) the score is the share of label 1 among the labelled rows, 1.0
when there are none. Other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import chunks, labelled_sample, string_buffers, text_of

HALF = 128
WIDTH = 8
STRIDE = 2
DIM = 8
FILTERS = 32
HIDDEN = 16
PAD = 256
_STEPS_PER_HALF = HALF // STRIDE
_SPAN = 2 * HALF + WIDTH


@dataclass
class ConvNet:
    """Weights of the network; ``constant`` replaces it when it could not be fitted."""

    weights: dict[str, np.ndarray]
    prior_shift: float = 0.0
    constant: float | None = None

    def probabilities(self, arr: pa.Array) -> np.ndarray:
        """Probability of label 1 for every text of an Arrow column."""
        if self.constant is not None:
            return np.full(len(arr), self.constant)
        out = np.empty(len(arr))
        for lo, hi, data, offsets in chunks(arr, 1 << 18):
            out[lo:hi] = self._run(data, offsets)
        return out

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p, n = self.weights, np.diff(offsets)
        blocks = np.maximum(2, -(-(n + WIDTH) // HALF))
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.full(int(first[-1]) * HALF + WIDTH, PAD, np.int16)
        at = np.repeat(first[:-1] * HALF - offsets[:-1], n) + np.arange(len(data))
        padded[at] = data
        x = p["E"][padded].reshape(-1)
        view = np.lib.stride_tricks.as_strided(
            x, (int(first[-1]) * _STEPS_PER_HALF, WIDTH * DIM), (x.itemsize * DIM * STRIDE, x.itemsize)
        )
        conv = np.ascontiguousarray(view) @ p["W"]
        half = conv.reshape(-1, _STEPS_PER_HALF, FILTERS).max(1)
        # chunk i of a document pools its halves i and i + 1
        left = np.delete(np.arange(first[-1]), first[1:] - 1)
        pooled = np.maximum(0, np.maximum(half[left], half[left + 1]) + p["b"])
        row = np.repeat(np.arange(len(n)), blocks - 1)
        within = left - first[row]
        fill = np.clip((n[row] - within * HALF) / (2 * HALF), 0, 1)
        z = _head(p, pooled, fill.astype(np.float32))
        starts = np.concatenate([[0], np.cumsum(blocks - 1)])[:-1]
        logit = _combine(p, z, starts, blocks - 1) + self.prior_shift
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _head(p: dict, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
    hidden = np.maximum(0, np.column_stack([pooled, fill]) @ p["A"] + p["a"])
    return hidden @ p["B"] + p["c"][0]


def _combine(p: dict, z: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(z.astype(np.float64), starts) / counts
    return p["m"][0] * mean + p["m"][1] * np.maximum.reduceat(z, starts) + p["m"][2] * np.minimum.reduceat(z, starts) + p["m"][3]


def _training_chunks(arr: pa.Array, per_doc: int) -> list[tuple[bytes, list[float]]]:
    """For each text: its chosen chunks (int16 bytes of a (k, _SPAN) array) and their fill."""
    data, offsets = string_buffers(arr)
    out = []
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        total = max(2, -(-(len(text) + WIDTH) // HALF)) - 1
        pick = np.unique(np.linspace(0, total - 1, min(total, per_doc)).round().astype(int))
        rows, fill = np.full((len(pick), _SPAN), PAD, np.int16), []
        for j, c in enumerate(pick):
            part = text[c * HALF : c * HALF + _SPAN]
            rows[j, : len(part)] = part
            fill.append(float(np.clip((len(text) - c * HALF) / (2 * HALF), 0, 1)))
        out.append((rows.tobytes(), fill))
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> dict:
    """Adam on the logistic loss; ``docs`` holds (chunks, fill) per document."""
    rng = np.random.default_rng(seed)
    p = {
        "E": rng.normal(0, 0.5, (257, DIM)), "W": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)),
        "b": np.zeros(FILTERS), "A": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS + 1, HIDDEN)), "a": np.full(HIDDEN, 0.1),
        "B": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "c": np.zeros(1), "m": np.array([0.6, 0.2, 0.2, 0.0]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["E"][PAD] = 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, batch // 2) for c in by_class])
        g = _gradients(p, [_shortened(docs[i], rng) if y[i] and rng.random() < 0.12 else docs[i] for i in pick], y[pick])
        lr = rate * min(1, step / 50) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        p["E"][PAD] = 0
    return p


def _shortened(doc: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The beginning of one chunk as a document of its own: a piece of good text is good, however short."""
    rows = doc[0][[rng.integers(len(doc[0]))]].copy()
    length = int(rng.integers(3, 60))
    rows[:, length:] = PAD
    return rows, np.minimum(doc[1][:1], length / (2 * HALF)).astype(np.float32)


def _gradients(p: dict, docs: list, y: np.ndarray) -> dict:
    x = np.concatenate([d[0] for d in docs])
    fill = np.concatenate([d[1] for d in docs])
    counts = np.array([len(d[0]) for d in docs])
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(docs)), counts)
    windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, : 2 * HALF : STRIDE]  # chunk, step, byte
    conv = p["E"][windows].reshape(-1, WIDTH * DIM) @ p["W"]
    conv = conv.reshape(len(x), -1, FILTERS)
    best = conv.argmax(1)
    raw = np.take_along_axis(conv, best[:, None], 1)[:, 0] + p["b"]
    pooled = np.maximum(0, raw)
    joined = np.column_stack([pooled, fill]).astype(np.float32)
    pre = joined @ p["A"] + p["a"]
    hidden = np.maximum(0, pre)
    z = hidden @ p["B"] + p["c"][0]
    logit = _combine(p, z, starts, counts)
    d = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / len(y)
    g = {"m": np.array([(d * np.add.reduceat(z, starts) / counts).sum(), (d * np.maximum.reduceat(z, starts)).sum(), (d * np.minimum.reduceat(z, starts)).sum(), d.sum()])}
    dz = d[row] * p["m"][0] / counts[row]
    for k, extreme in ((1, np.maximum), (2, np.minimum)):
        at = z == extreme.reduceat(z, starts)[row]
        share = at / np.add.reduceat(at.astype(float), starts)[row]
        dz = dz + d[row] * p["m"][k] * share
    g["B"], g["c"] = hidden.T @ dz, np.array([dz.sum()])
    dpre = np.outer(dz, p["B"]) * (pre > 0)
    g["A"], g["a"] = joined.T @ dpre, dpre.sum(0)
    draw = (dpre @ p["A"].T)[:, :FILTERS] * (raw > 0)
    g["b"] = draw.sum(0)
    won = windows[np.arange(len(x))[:, None], best]  # chunk, filter, byte
    vectors = p["E"][won].reshape(len(x), FILTERS, WIDTH * DIM)
    g["W"] = np.einsum("cf,cfk->kf", draw, vectors)
    de = (draw[:, :, None] * p["W"].T[None]).reshape(-1, DIM)
    flat = won.reshape(-1)
    g["E"] = np.stack([np.bincount(flat, de[:, k], 257) for k in range(DIM)], 1)
    return {k: v.astype(np.float32) for k, v in g.items()}


def train(
    docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality",
    text_col: str = "text", id_col: str = "doc_id", per_class: int = 700, chunks_per_doc: int = 24, steps: int = 500,
) -> ConvNet:
    """Fit the network on a bounded sample of the labelled rows that ``train_rows`` admits.

    ``per_class`` and ``chunks_per_doc`` bound what reaches the driver:
    ``2 * per_class * chunks_per_doc`` chunks of 264 bytes.
    """
    sample = labelled_sample(labels, label, train_rows, per_class, id_col)

    @F.arrow_udf("struct<chunks: binary, fill: array<float>>")
    def cut(texts: pa.Array) -> pa.Array:
        got = _training_chunks(texts, chunks_per_doc)
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.list_(pa.float32()))], ["chunks", "fill"]
        )

    rows = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .join(F.broadcast(sample), "id")
        .select("id", "y", cut("text").alias("cut"))
        .groupBy("id", "y").agg(F.min("cut").alias("cut"))  # an id that repeats counts once
        .orderBy("id").collect()
    )
    y = np.array([r["y"] for r in rows])
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return ConvNet({}, constant=n1 / (n1 + n0) if n1 + n0 else 1.0)
    data = [(np.frombuffer(r["cut"]["chunks"], np.int16).reshape(-1, _SPAN), np.array(r["cut"]["fill"], np.float32)) for r in rows]
    share = labels.where(F.col(label).isin(0, 1) & train_rows).agg(F.avg(F.col(label))).first()[0]
    # fitted on classes of equal weight; scores carry the label's own share (kept off 0 and 1)
    share = min(max(float(share), 0.02), 0.98)
    return ConvNet(fit(data, y, steps), prior_shift=float(np.log(share / (1 - share))))


def score(model: ConvNet, text_col: str = "text") -> Column:
    """Column of the probability of label 1 for the whole text."""

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(model.probabilities(arr), pa.float64())

    return probability(text_of(text_col))
