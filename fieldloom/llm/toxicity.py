"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words count as they are and by their first letters, which stand for their stem. Each feature has a learning rate of its own, from the squared gradients it has seen, and L1 keeps the weight of a
feature at zero until it has earned more; what is left is a small sparse table, which is broadcast to the scorer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.labels import id_crc32, labelled_sample
from fieldloom.llm.text import join_hashes, mix, plain_tokens, word_hashes

BITS = 20
#: Labelled documents that are learned from, at most.
SAMPLE = 8_000
#: First bytes of a word that stand for its inflected forms.
STEMS = (4, 6)
_SKIP = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def features(text: bytes | None) -> np.ndarray:
    """Hashed unigrams of words and of their stems, bigrams, and skip-grams over one and two words, each once."""
    ws = plain_tokens(text)
    h = word_hashes(ws)
    parts = [mix(h), join_hashes(h[:-1], h[1:]), *(mix(word_hashes([w[:n] for w in ws], n)) for n in STEMS)]
    parts += [join_hashes(h[: -gap - 1] ^ salt, h[gap + 1 :]) for gap, salt in zip((1, 2), _SKIP)]
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


_GAP = 0xFFFF


def packed(at: np.ndarray) -> bytes:
    """Ascending features as gaps of two bytes; a larger gap is a run of the greatest value and what is left."""
    gap = np.diff(at, prepend=0)
    many = gap // _GAP
    out = np.full(len(gap) + int(many.sum()), _GAP, "<u2")
    out[np.cumsum(many + 1) - 1] = gap % _GAP
    return out.tobytes()


def unpacked(data: np.ndarray) -> np.ndarray:
    """The features of ``packed``."""
    return np.cumsum(data, dtype=np.int64)[data != _GAP]


@dataclass
class Model:
    """A bias and the features whose weight isn't zero."""

    bias: float
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.at] = self.weight
        return w


def sigmoid(x: float | np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, epochs: int = 4, unpack=None) -> Model:
    """FTRL-proximal over ``(features, label)`` rows in their order, features unpacked when a row's turn comes. No rows, or one label only: its rate as bias."""
    y_all = np.array([y for _, y in rows], float)
    if not len(rows) or y_all.min() == y_all.max():
        p = (y_all.sum() + 0.5) / (len(rows) + 1) if len(rows) else 1e-3
        return Model(float(np.log(p / (1 - p))), np.empty(0, np.int64), np.empty(0))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rate = lambda n: (beta + np.sqrt(n)) / alpha + l2
    for _ in range(epochs):
        for at, y in rows:
            at = unpack(at) if unpack else at
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / rate(ni))
            bias = -bias_z / rate(bias_n)
            g = float(sigmoid(w.sum() + bias)) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    return Model(float(-bias_z / rate(bias_n)), at, (np.sign(z[at]) * l1 - z[at]) / rate(n[at]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = 42) -> Model:
    """A model from at most ``most`` labelled rows whose crc32(doc_id as text) mod 5 isn't 0, and SAMPLE_BYTES of text.

    Only features reach the driver, two bytes each: about twice the bytes of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("sig"), pa.array([packed(f) for f in found], pa.binary())], ["doc_id", "y", "sig", "features"])

    sample = labelled_sample(docs, labels, "toxic", most, seed=seed, where=id_crc32(F.col("doc_id")) % 5 != 0)
    sample = sample.select("doc_id", "y", "sig", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, y int, sig long, features binary")
    t = sample.toArrow()
    order = np.lexsort((t["sig"].to_numpy(), t["y"].to_numpy(), mix(t["doc_id"].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(seed))))
    held = t["features"].combine_chunks() if t.num_rows else None
    rows = [(np.frombuffer(held[k].as_buffer(), "<u2"), y) for k, y in zip(order.tolist(), t["y"].to_numpy()[order].tolist())]
    return fit(rows, unpack=unpacked)


def _scores(texts: pa.Array, bias: float, weights: np.ndarray) -> np.ndarray:
    return sigmoid(np.fromiter((weights[features(t.as_py())].sum() for t in texts), float, len(texts)) + bias)


_dense: dict[bytes, np.ndarray] = {}


def _weights(model: Model) -> np.ndarray:
    key = model.at.tobytes() + model.weight.tobytes()
    if key not in _dense:
        _dense.clear()
        _dense[key] = model.dense()
    return _dense[key]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no features: their score is that of the bias. A null doc_id counts as the empty text
    for ``held_out``. Repeated rows are kept. Empty table: no rows. Labels that are missing, null or of one kind
    leave a model of the bias alone. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            p = _scores(b.column("text"), model.bias, _weights(model))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (id_crc32(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``most``.

    Null and empty texts have the bias's score, so they stay unless the bias alone rejects. Repeated rows and null
    ids stay as they are. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            p = _scores(b.column("text").cast(pa.binary()), model.bias, _weights(model))
            yield b.filter(pa.array(p < most))

    return docs.mapInArrow(run, docs.schema)
