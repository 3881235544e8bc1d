"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown level by level on binned features, under monotonic constraints (more symbols, repeated words or
repeated lines never raise the score), and flattened into numpy arrays of nodes, so a batch of documents goes down
all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.labels import labelled_sample
from fieldloom.llm.text import SPACES, window_hashes, word_hashes, words

#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_per_word", "words_per_line", "longest_word", "longest_run_share"]
#: -1: the score never rises with the feature.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1}
_NO_UPPER, _NO_LOWER, _NO_DIGIT = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
_PUNCT = b"!\"'(),-./:;?[]{}~^_`@+="


def repeat_words(h: np.ndarray, width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur twice or more."""
    g = window_hashes(h, width)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    again = np.zeros(len(g), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(g)] += again
    edge[width : width + len(g)] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts and the features of a text."""
    text = text or b""
    ws = words(text)
    n = len(ws)
    raw = np.frombuffer(text, np.uint8)
    points = len(raw) - int(((raw & 0xC0) == 0x80).sum())
    chars = points - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    h = word_hashes(ws)
    repeat = repeat_words(h)
    counts = [n, chars, symbols, dup, repeat]
    if not n:
        return counts, [0.0] * len(FEATURES)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    upper, lower = without(_NO_UPPER), without(_NO_LOWER)
    changes = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
    return counts, [
        np.log1p(n),
        chars / n,
        symbols / n,
        dup / len(lines),
        repeat / n,
        len(np.unique(h)) / n,
        upper / max(upper + lower, 1),
        without(_NO_DIGIT) / chars,
        without(_PUNCT) / n,
        n / len(lines),
        min(max(map(len, ws)), 1000),
        int(np.diff(changes).max()) / n,
    ]


# ---------------------------------------------------------------------------------------------------- trees


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5, monotone: dict[str, int] | None = None) -> Forest:
    """Boosted trees for labels 0 and 1. No rows, or one label only: a forest without trees."""
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 1 - 1e-3
    nodes: list[list] = []  # feature, cut, left, right, value
    roots: list[int] = []
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    if len(y) and y.min() < y.max():
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            roots.append(_grow(nodes, binned, cuts, q - y, q * (1 - q), margin, signs, depth, rate, l2, least))
    a = list(zip(*nodes)) if nodes else [[], [], [], [], []]
    return Forest(np.array(a[0], np.int64), np.array(a[1], float), np.array(a[2], np.int64), np.array(a[3], np.int64), np.array(a[4], float), np.array(roots, np.int64), base, depth)


def _grow(nodes: list, binned: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, margin: np.ndarray, signs: np.ndarray, depth: int, rate: float, l2: float, least: int) -> int:
    """Adds a tree to ``nodes`` and its values to ``margin``; returns the root."""

    def leaf(rows: np.ndarray, low: float, high: float) -> int:
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high)) * rate
        margin[rows] += value
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        if level == depth or len(rows) < 2 * least:
            return leaf(rows, low, high)
        gs, hs = g[rows], h[rows]
        total_g, total_h = gs.sum(), hs.sum()
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            k = binned[rows, f]
            left_g = np.cumsum(np.bincount(k, gs, len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(k, hs, len(c) + 1))[:-1]
            left_n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
            lv, rv = np.clip(-left_g / (left_h + l2), low, high), np.clip(-right_g / (right_h + l2), low, high)
            fine = (left_n >= least) & (len(rows) - left_n >= least) & (signs[f] * (rv - lv) >= 0)
            if fine.any():
                at = int(np.argmax(np.where(fine, gain, -np.inf)))
                if gain[at] > best[0]:
                    best = (gain[at], (f, at, lv[at], rv[at]))
        if best[1] is None:
            return leaf(rows, low, high)
        f, at, lv, rv = best[1]
        goes = binned[rows, f] <= at
        mid = (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[f])]
        nodes.append([f, float(cuts[f][at]), 0, 0, 0.0])
        me = len(nodes) - 1
        nodes[me][2] = grow(rows[goes], level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1])
        return me

    return grow(np.arange(len(g)), 0, -4.0, 4.0)


# ------------------------------------------------------------------------------------------------ DataFrames


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = 42) -> Forest:
    """A forest from at most ``most`` labelled rows; only their features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py())[1] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("sig"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "sig", "x"])

    sample = labelled_sample(docs, labels, "quality", most, seed=seed).select("doc_id", "y", "sig", F.col("text").cast("binary").alias("text"))
    t = sample.mapInArrow(run, "doc_id long, y int, sig long, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("sig", "ascending")])
    return fit(np.array(t["x"].to_pylist(), float).reshape(-1, len(FEATURES)), t["y"].to_numpy().astype(float))


def assess(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` of every row.

    ``base_failed``: fewer than 10 words, or over a fifth of them in repeated windows. ``kept``: not so, and the
    forest's probability of good quality is ``least`` or more.

    Null and empty texts, and texts of white space: all counts zero, failed. Null doc_ids and repeated rows are
    kept. Empty table: no rows. Without usable labels the forest has no trees and the base rules decide.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            counts, x = zip(*(statistics(t.as_py()) for t in b.column("text")))
            counts = np.array(counts, np.int64)
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            p = np.concatenate([forest.probability(np.array(x[k : k + 4096])) for k in range(0, len(x), 4096)])
            cols = [b.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")
