"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (``passage_bytes`` bytes each, the whole text).
Each passage is encoded from character frequencies and word statistics by a
small network; gated attention learns from document labels alone which
passages matter, and the attention-weighted passage representation is scored.

The network is fitted on the driver, on at most ``sample`` labelled documents
chosen by a hash of their id (texts above ``longest`` bytes are not used to
fit, which bounds the driver's features to 215 MB); this is the only bounded part.  Scoring reads every passage of every
text in Arrow batches, without a shuffle.  Fitting is deterministic: the
sample does not depend on partitioning, and seeds are fixed.

Null and empty texts are one empty passage and get its score.  Labels that are
null or belong to no document are not used; of several labels for one document
the least counts.  Without labels of both classes every score is the share of
label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .sparkops import bounded_batches

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BINS = 129
STATS = 9
WIDTH = BINS + STATS
_CLASS = np.minimum(np.arange(256), 128)


def passages(data: np.ndarray, offsets: np.ndarray, size: int, powers: B.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, row of each passage)."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // size))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    row = np.repeat(np.arange(len(lengths)), counts)
    bounds = offsets[:-1][row] + (np.arange(total) - first[:-1][row]) * size
    ends = np.minimum(bounds + size, offsets[1:][row])
    held = np.maximum(ends - bounds, 0)
    owner = np.repeat(np.arange(total), held)
    histogram = np.bincount(owner * BINS + _CLASS[data], minlength=total * BINS).reshape(total, BINS).astype(np.float32)
    share = histogram / np.maximum(held, 1)[:, None]
    out = np.zeros((total, WIDTH), np.float32)
    out[:, :BINS] = np.sqrt(share)
    letters, upper = np.maximum(histogram @ LETTER[:BINS].astype(np.float32), 1), histogram @ UPPER[:BINS].astype(np.float32)
    starts, stops, word_row = B.word_spans(data, offsets, ~SPACE)
    words = B.span_hashes(data, starts, stops, B.LOWER_VALUES, powers)
    mine = owner[starts] if len(starts) else starts
    n = np.maximum(np.bincount(mine, minlength=total), 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])
    order = np.lexsort((words, mine))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (mine[order][1:] != mine[order][:-1])
    odd_end = ~(LETTER | DIGIT | (np.isin(np.arange(256), list(b".,;:'\")"))))
    stats = [
        upper / letters,
        np.bincount(mine, again, total) / n,
        np.bincount(mine[order], new, total) / n,
        np.bincount(mine, stops - starts, total) / n / 10,
        np.bincount(mine, odd_end[data[stops - 1]], total) / n if len(stops) else np.zeros(total),
        np.bincount(mine, stops - starts == 1, total) / n,
        histogram @ DIGIT[:BINS].astype(np.float32) / np.maximum(held, 1),
        np.log1p(held) / 10,
        np.log1p(lengths[row]) / 10,
    ]
    out[:, BINS:] = np.stack(stats, 1)
    return out, row


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        z = x @ w["encode"] + w["encode0"]
        h = np.maximum(z, 0)
        u, g = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (u * g) @ w["attend"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[row])
        a /= np.add.reduceat(a, starts)[row]
        m = np.add.reduceat(a[:, None] * h, starts)
        logit = m @ w["score"] + w["score0"][0]
        return {"x": x, "z": z, "h": h, "u": u, "g": g, "a": a, "m": m, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(rows, self.constant)
        starts = np.searchsorted(row, np.arange(rows))
        return self.forward(x, starts, row)["p"].astype(np.float64)


def start(bags: list[np.ndarray], hidden: int, attention: int, rng: np.random.Generator) -> Model:
    """A model with random weights, scaled to the passages."""
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 0.02, {})
    w = model.weights
    w["encode"] = rng.normal(0, (2 / WIDTH) ** 0.5, (WIDTH, hidden)).astype(np.float32)
    w["encode0"] = np.zeros(hidden, np.float32)
    for name in ("value", "gate"):
        w[name] = rng.normal(0, (1 / hidden) ** 0.5, (hidden, attention)).astype(np.float32)
    w["attend"] = rng.normal(0, 0.1, attention).astype(np.float32)
    w["score"] = rng.normal(0, 0.1, hidden).astype(np.float32)
    w["score0"] = np.zeros(1, np.float32)
    return model


def gradients(model: Model, f: dict[str, np.ndarray], starts: np.ndarray, row: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy by each weight, after the forward pass ``f``."""
    w = model.weights
    d = ((f["p"] - labels) / len(labels)).astype(w["score"].dtype)
    grad = {"score": f["m"].T @ d, "score0": d.sum(keepdims=True)}
    dm = (d[:, None] * w["score"])[row]
    dh = f["a"][:, None] * dm
    da = (f["h"] * dm).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[row])
    ug = f["u"] * f["g"]
    grad["attend"] = ug.T @ de
    dug = de[:, None] * w["attend"]
    du, dg = dug * f["g"] * (1 - f["u"] ** 2), dug * ug * (1 - f["g"])
    grad["value"], grad["gate"] = f["h"].T @ du, f["h"].T @ dg
    dz = (dh + du @ w["value"].T + dg @ w["gate"].T) * (f["z"] > 0)
    grad["encode"], grad["encode0"] = f["x"].T @ dz, dz.sum(0)
    return grad


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, attention: int = 16, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit by Adam on the cross entropy of the document labels."""
    if len({*labels.tolist()}) < 2:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    model = start(bags, hidden, attention, rng)
    w = model.weights
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            row = np.repeat(np.arange(len(pick)), sizes)
            f = model.forward(np.concatenate([bags[i] for i in pick]), starts, row)
            grad = gradients(model, f, starts, row, labels[pick])
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= now * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * w[k])
    return model


def training_bags(docs: DataFrame, labels: DataFrame, label: str, sample: int, longest: int, passage_bytes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and labels of the sampled documents, by doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of 12 bytes.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = B.Powers()
        for batch, data, offsets in B.pieces(batches, 1):
            x, row = passages(data, offsets, passage_bytes, powers)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            made = [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["doc_id", "y", "x"])

    # Of rows that share a sampled doc_id the smallest text is taken, so that the bound holds.
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows], np.array([r["y"] for r in rows], np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, label: str = "quality", sample: int = 6000, longest: int = 1 << 16, passage_bytes: int = 1024) -> DataFrame:
    """docs with score (0 to 1; higher: label 1 is likelier) and predicted (0 or 1)."""
    if clash := {"score", "predicted"} & {*docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    model = fit(*training_bags(docs if train_docs is None else train_docs, labels, label, sample, longest, passage_bytes))
    columns, at = [*docs.columns, "score"], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = B.Powers()
        for batch, data, offsets in B.pieces(batches, at):
            x, row = passages(data, offsets, passage_bytes, powers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x, row, batch.num_rows))], names=columns)

    from pyspark.sql import types as T

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = quality_scores(docs.select("doc_id", "text"), labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
