"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over each whole text; the trees are fitted on a bounded sample
of labelled rows and flattened into arrays that numpy walks for all rows and trees at once.
A null or empty text has all statistics zero and gets a score like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.common import labelled_sample

#: The classifier is fitted on at most this many labelled rows.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, L2 = 60, 4, 48, 0.15, 10, 1.0

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "non_ascii", "full_stop", "comma", "exclaim", "symbol",
    "pipe", "bracket", "distinct_bytes", "entropy", "log_words", "word_bytes", "distinct_words", "log_lines", "line_bytes", "repeated_lines", "stopped_lines", "top_byte",
)

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*+=@^~<>\\_`", np.uint8))
_BRACKET = np.isin(np.arange(256), np.frombuffer(b"()[]{}", np.uint8))


def statistics_of(text: str | None) -> np.ndarray:
    out = np.zeros(len(FEATURES), np.float32)
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return out
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = data.split(), data.split(b"\n")
    out[:] = (
        np.log1p(n), counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n, counts[128:].sum() / n,
        counts[46] / n, counts[44] / n, counts[33] / n, counts[_SYMBOL].sum() / n, counts[124] / n, counts[_BRACKET].sum() / n, len(share), -(share * np.log(share)).sum(),
        np.log1p(len(words)), n / max(len(words), 1), len(set(words)) / max(len(words), 1), np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), share.max(),
    )
    return out


def statistics(text: Column) -> Column:
    """Array of FEATURES of a text."""

    @F.pandas_udf("array<float>")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(x) for x in batch], dtype=object)

    return of(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has the children 2i+1 and 2i+2; leaves hold additive log-odds."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x, all trees walked together."""
        trees, rows = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        total = self.start + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with the logistic loss; splits come from histograms of gradients over quantile bins.

    Without both labels the result is a constant.
    """
    inner = 2**DEPTH - 1
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    if len(np.unique(y)) < 2:
        return Trees(start, feature, cut, leaf)
    x = x.astype(np.float64)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cells = binned + BINS * np.arange(x.shape[1])
    width, margin = BINS * x.shape[1], np.full(len(y), start)
    for t in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            count = 2**level
            flat = ((node - first)[:, None] * width + cells).ravel()
            sums = [np.bincount(flat, np.repeat(v, x.shape[1]), count * width).reshape(count, -1, BINS).cumsum(axis=2) for v in (grad, hess, np.ones(len(y)))]
            g, h, n = sums
            gain = g**2 / (h + L2) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + L2) - g[..., -1:] ** 2 / (h[..., -1:] + L2)
            gain[(n < MIN_LEAF) | (n[..., -1:] - n < MIN_LEAF)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                if gain[k].ravel()[best[k]] > 1e-6:
                    feature[t, first + k], b = divmod(int(best[k]), BINS)
                    cut[t, first + k] = edges[feature[t, first + k]][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf[t] = RATE * g / (h + L2)
        margin += leaf[t, at]
    return Trees(start, feature, cut, leaf)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; their statistics are computed by Spark."""
    sample = labelled_sample(labels, "doc_id", label, folds, held_out, rows)
    one = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(sample), "_id")
    got = one.select("_id", "_label", statistics(F.col("_text")).alias("x")).orderBy(F.xxhash64("_id"), "_id").limit(rows).toPandas()
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["_label"].to_numpy(float))


def score(text: Column, model: Trees) -> Column:
    """Probability of label 1."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack([statistics_of(t) for t in batch]) if len(batch) else np.zeros((0, len(FEATURES)), np.float32)
            yield pd.Series(model.score(x))

    return of(F.coalesce(text, F.lit("")))
