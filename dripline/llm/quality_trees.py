"""Quality by gradient-boosted trees over statistics of a document.

The statistics of each text (shares of kinds of characters, repetition of words, runs and lines,
lengths) are cut into bins at quantiles. Trees are grown level by level: for every node the sums
of gradients and curvatures by bin make a histogram, and the best split is read from its
cumulative sums. All trees are complete and stored flat, node i with children 2 i + 1 and 2 i + 2,
so that scoring walks all documents of a batch down one level at a time with array operations.

The model is fitted on a bounded sample: at most ``per_class`` labelled documents of each class
that are not held out, the smallest by hash; only their statistics (a few hundred bytes each)
reach the driver. Classes count by their size among all labelled rows, so scores estimate
probabilities. All texts are then scored, whole.

Defined results: a null or empty text has the statistics of a text without words and is scored
like any other. Repeated rows are learned once and scored each; a null id is not held out and not
learned; an id with contradicting labels counts as good. Without rows of both classes every score
is the share of good rows (1 without any). Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dripline.llm.support import (
    collect_sorted,
    fold,
    held_out,
    labelled_sample,
    ship,
    strings,
)

PER_CLASS = 10_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
PENALTY = 1.0
LEAST_CURVATURE = 0.5

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "distinct_words", "commonest_word",
    "repeated_neighbours", "distinct_triples", "words_a_line", "repeated_lines", "upper", "digits",
    "symbols", "exclamations", "bars", "other_marks", "spaces", "beyond_ascii", "line_ends",
    "entropy", "longest_word",
)


def _bytes_in(characters: str) -> np.ndarray:
    inside = np.zeros(256)
    inside[list(characters.encode())] = 1
    return inside


_KINDS = np.array(
    [
        _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _bytes_in("0123456789"),
        _bytes_in("#*$%&<>@^~=+"),
        _bytes_in("!?"),
        _bytes_in("|"),
        _bytes_in(".,;:'\"()[]{}-_/\\`"),
        _bytes_in(" \t"),
        (np.arange(256) >= 128).astype(float),
        _bytes_in("\n\r"),
    ]
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of :data:`STATISTICS`."""
    words = text.split()
    n = len(words)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8) if text else None
    if data is None:
        kinds, entropy = np.zeros(len(_KINDS)), 0.0
    else:
        shares = np.bincount(data, minlength=256) / len(data)
        kinds = _KINDS @ shares
        present = shares[shares > 0]
        entropy = float(-(present * np.log2(present)).sum())
    if n == 0:
        return [0.0] * 9 + [float(x) for x in kinds] + [entropy, 0.0]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    seen = Counter(words)
    triples = max(1, n - 2)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        n / max(1, len(lines)),
        1.0 - len(set(lines)) / max(1, len(lines)),
        *(float(x) for x in kinds),
        entropy,
        float(np.log1p(lengths.max())),
    ]


@dataclass
class Trees:
    """Complete trees of one depth: split statistic and threshold by node, value by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            while inner and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if len(rows) == 0:
            return np.zeros(0)
        return 0.5 * (1.0 + np.tanh(0.5 * self.margins(rows)))


def _constant(share: float) -> Trees:
    start = np.inf if share >= 1 else -np.inf if share <= 0 else float(np.log(share / (1 - share)))
    return Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), start)


def grow(
    rows: np.ndarray,
    target: np.ndarray,
    importance: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
) -> Trees:
    """Boosted trees for the logistic loss, from histograms of the binned statistics."""
    n, width = rows.shape
    cuts = [
        np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)
    ]
    binned = np.stack(
        [np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1
    )
    importance = importance * (n / importance.sum())
    share = float((importance * target).sum() / n)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    inner = (1 << depth) - 1
    features = np.zeros((trees, inner), dtype=np.int64)
    thresholds = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 0.5 * (1.0 + np.tanh(0.5 * margin))
        gradient = importance * (target - p)
        curvature = importance * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for f in range(width):
                cell = (node - first) * BINS + binned[:, f]
                size = count * BINS
                g = np.bincount(cell, gradient, minlength=size).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(cell, curvature, minlength=size).reshape(count, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = (
                    g**2 / (h + PENALTY)
                    + (all_g - g) ** 2 / (all_h - h + PENALTY)
                    - all_g**2 / (all_h + PENALTY)
                )
                gain[(h < LEAST_CURVATURE) | (all_h - h < LEAST_CURVATURE)] = 0.0
                gain[:, len(cuts[f]) :] = 0.0
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = np.flatnonzero(value > best + 1e-9)
                best[better] = value[better]
                features[t, first + better] = f
                thresholds[t, first + better] = cuts[f][at[better]]
            node = 2 * node + 1 + (
                rows[np.arange(n), features[t, node]] > thresholds[t, node]
            )
        g = np.bincount(node - inner, gradient, minlength=inner + 1)
        h = np.bincount(node - inner, curvature, minlength=inner + 1)
        leaves[t] = RATE * g / (h + PENALTY)
        margin += leaves[t, node - inner]
    return Trees(features, thresholds, leaves, start)


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS
) -> Trees:
    totals = {
        int(row["label"]): row["n"]
        for row in labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    if not totals.get(0) or not totals.get(1):
        return _constant(0.0 if totals.get(0) else 1.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x) for x in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.string()),
                    batch.column("label"),
                    pa.array(found, pa.list_(pa.float64())),
                ],
                names=["doc_id", "label", "found"],
            )

    sample = labelled_sample(documents, labels, label, FOLDS, HELD_OUT, per_class)
    known = collect_sorted(
        sample.mapInArrow(measure, "doc_id string, label int, found array<double>"),
        "doc_id",
    )
    target = known.column("label").to_numpy().astype(float)
    if len(set(target)) < 2:  # the labelled texts of a class are missing
        return _constant(float(target[0]) if len(target) else 1.0)
    rows = np.array(known.column("found").to_pylist())
    n = np.bincount(target.astype(int), minlength=2)
    weight = np.array([totals[0] / n[0], totals[1] / n[1]])
    return grow(rows, target, weight[target.astype(int)])


def with_score(
    documents: DataFrame, labels: DataFrame, name: str, text: str = "text", **settings
) -> DataFrame:
    """The documents with the score of their text in one more column."""
    spark = documents.sparkSession
    ship(spark)
    plain = documents.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text"))
    model = spark.sparkContext.broadcast(fit(plain, labels, **settings))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(x or "") for x in texts], dtype=float)
        return pd.Series(model.value.scores(rows.reshape(len(texts), len(STATISTICS))))

    return documents.withColumn(name, score(F.col(text)))


def scores(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    threshold: float = THRESHOLD,
    **settings,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    texts = documents.select("doc_id", "text")
    scored = with_score(texts, labels, "score", label=label, **settings)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
