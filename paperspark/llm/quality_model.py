"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are Spark expressions. Trees are fitted on a bounded sample of
labelled rows, flattened into arrays, and walked for whole Arrow batches at a
time with numpy, one level of all rows per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperspark.llm.common import staged
from paperspark.llm.quality_rules import base_statistics, transformed

# At most so many labelled rows are used to fit, taken by the hash of their id.
TRAIN_ROWS = 20_000
N_TREES, DEPTH, N_BINS = 60, 4, 64
RATE, RIDGE, LEAST_ROWS = 0.2, 1.0, 5


def features() -> dict[str, Column]:
    """Columns over the output of ``base_statistics``. They describe the text
    alone: no id, language, source or label."""
    def share(name: str, of: str = "n_chars") -> Column:
        return F.col(name) / F.greatest(F.col(of), F.lit(1))

    return transformed() | {
        "f_words": F.log1p("n_words"), "f_lines": F.log1p("n_lines"),
        "f_digits": share("n_digits"), "f_marks": share("n_marks"),
        "f_wide": share("n_bytes"), "f_line_words": F.log1p(share("n_words", "n_lines")),
        "f_dup_lines": share("n_dup_lines", "n_lines"), "f_repeats": share("n_repeat_words", "n_words"),
    }


@dataclass
class Forest:
    """Complete binary trees: node k of a tree has children 2k+1 and 2k+2."""
    prior: float
    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray  # tree x inner node; larger values go right
    value: np.ndarray  # tree x leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.prior)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH) -> Forest:
    """Newton boosting of the logistic loss on binned statistics. Without
    rows, every score is one half; with one class, the prior decides."""
    n, p = x.shape
    inner = 2 ** depth - 1
    mean = (y.sum() + 0.5) / (n + 1.0)
    prior = float(np.log(mean / (1 - mean)))
    feature = np.zeros((n_trees, inner), np.int64)
    threshold = np.full((n_trees, inner), np.inf)
    value = np.zeros((n_trees, inner + 1))
    if not n or y.min() == y.max():
        return Forest(prior, feature[:0], threshold[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, N_BINS + 1)[1:-1])) for j in range(p)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(p)], axis=1)
    offset = np.arange(p) * N_BINS
    total = np.full(n, prior)
    for t in range(n_trees):
        prob = 1.0 / (1.0 + np.exp(-total))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            slot = (((node - first)[:, None] * p * N_BINS) + offset + bins).ravel()
            shape = (width, p, N_BINS)
            g, h, c = (np.bincount(slot, np.repeat(w, p), minlength=width * p * N_BINS).reshape(shape).cumsum(2)
                       for w in (grad, hess, np.ones(n)))
            g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g ** 2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all ** 2 / (h_all + RIDGE)
            gain[(c < LEAST_ROWS) | (c_all - c < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), N_BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > threshold[t][node])
        leaf = node - inner
        g, h = (np.bincount(leaf, w, minlength=inner + 1) for w in (grad, hess))
        value[t] = RATE * g / (h + RIDGE)
        total += value[t][leaf]
    return Forest(prior, feature, threshold, value)


def held_out(doc_id: Column, parts: int = 5, out: int = 0) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == out


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", train_rows: int = TRAIN_ROWS, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row's whole text.

    Fits on at most ``train_rows`` labelled rows whose id is not held out.
    Null and empty texts have the statistics of an empty text; null labels
    are ignored, several labels of one id are averaged, and repeated
    documents are scored one by one. A null id is never in the training part
    nor held out. Other columns are ignored.
    """
    names = list(features())
    rows = staged(base_statistics(docs, id_col, text_col).select(
        "doc_id", *[c.cast("double").alias(n) for n, c in features().items()]), "quality-statistics")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("y").isNotNull()).groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = rows.join(marks, "doc_id").where(~held_out(F.col("doc_id")))
    # A share of the hash range holds about the wanted number, so that few
    # rows more than these travel to the driver.
    n = train.count()
    share = min(1.0, 1.1 * train_rows / max(1, n))
    train = (train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
             .orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(train_rows).select("y", *names).toPandas())
    forest = fit(train[names].to_numpy(float), train["y"].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": forest.score(batch[names].to_numpy(float))})

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
