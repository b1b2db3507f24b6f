"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a tree of at most four leaves on one feature's bins
and adds it, damped, to that feature's lookup table. Then the pairs whose residuals gain most from a
two-cut tree get tables of their own in the same way. A score is the logistic of a sum of table entries,
added up for whole batches at once.

Inputs are text statistics alone. Null or empty text is scored as the empty text. Repeated rows get equal
scores. Without labelled rows every score is 0.5. Other columns, whatever their names, are passed over or through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.llm.labelled import held_out, training_sample
from auditloom.llm.text_stats import FEATURES, measure

BINS, COARSE, PAIRS, THRESHOLD = 48, 8, 6, 0.3


@dataclass(frozen=True)
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # from a feature's bin to its bin in pair tables
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(edges, x[:, f], side="left") for f, edges in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, bins = np.full(len(x), self.intercept), self.bins(x)
        for found, entries in zip(bins, self.tables):
            total += entries[found]
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            total += entries[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(gradient: np.ndarray, weight: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best cut of bins low..high-1 into two, by the gain in squared gradient sums."""
    g, h = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
    if high - low < 2:
        return 0.0, low
    left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
    gains = left + right - g[-1] ** 2 / (h[-1] + 1)
    best = int(np.argmax(gains))
    return float(gains[best]), low + best + 1


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values per bin of a shallow tree over ordered bins."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        gain, cut, n = max((*_split(gradient, weight, *part), n) for n, part in enumerate(parts))
        if gain <= 1e-9:
            break
        low, high = parts.pop(n)
        parts += [(low, cut), (cut, high)]
    out = np.zeros(len(gradient))
    for low, high in parts:
        out[low:high] = gradient[low:high].sum() / (weight[low:high].sum() + 1)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut along each axis of a grid: its gain and its values."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, found = 0.0, np.zeros_like(gradient)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            gs = (g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j])
            hs = (h[i, j], h[i, -1] - h[i, j], h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j])
            gain = sum(a * a / (b + 1) for a, b in zip(gs, hs))
            if gain > best:
                best, v = gain, [a / (b + 1) for a, b in zip(gs, hs)]
                found = np.zeros_like(gradient)
                found[:i + 1, :j + 1], found[:i + 1, j + 1:], found[i + 1:, :j + 1], found[i + 1:, j + 1:] = v
    return best, found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Model:
    if not len(x):
        return Model(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [np.zeros(1, int)] * len(FEATURES), [], [])
    count = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(count)]
    bins = [np.searchsorted(edges[f], x[:, f], side="left") for f in range(count)]
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.arange(n) * COARSE // max(n, COARSE) for n in sizes]
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    total, tables = np.full(len(y), intercept), [np.zeros(n) for n in sizes]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(count):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[f], g, sizes[f]), np.bincount(bins[f], h, sizes[f]))
            tables[f] += step
            total += step[bins[f]]
    shape = (COARSE, COARSE)

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[a][bins[a]] * COARSE + coarse[b][bins[b]]
        g, h = slopes()
        return cell, np.bincount(cell, g, COARSE * COARSE).reshape(shape), np.bincount(cell, h, COARSE * COARSE).reshape(shape)

    gains = sorted(((_quadrants(*grid(a, b)[1:])[0], a, b) for a in range(count) for b in range(a + 1, count)), reverse=True)
    pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    pair_tables = [np.zeros(shape) for _ in pairs]
    for _ in range(pair_rounds):
        for n, (a, b) in enumerate(pairs):
            cell, g, h = grid(a, b)
            step = rate * _quadrants(g, h)[1]
            pair_tables[n] += step
            total += step.ravel()[cell]
    return Model(intercept, edges, tables, coarse, pairs, pair_tables)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold (``labelled.MAX_TRAINING_ROWS``)."""
    return fit(*training_sample(docs, labels, "quality"))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    rows = [measure(text)[1] for text in utf8(column)]
    return model.score(np.array(rows, float).reshape(len(rows), len(FEATURES)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``THRESHOLD``)."""

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(_scores(model, batch.column("text")))], ["doc_id", "score"])

    return (docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model predicts as good, with all their columns as they came."""

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) >= THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
