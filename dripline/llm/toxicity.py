"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Which n-grams a text holds (not how often) are its features. For every n-gram the log of the ratio
of its smoothed shares among toxic and other documents is counted on labelled texts; the ratio
scales the feature, and a logistic regression learns the weight of the scaled features. So an
n-gram that says nothing has no pull, and one that says much needs little evidence.

The model is fitted on a bounded sample: at most ``per_class`` labelled documents of each class
that are not held out, the smallest by hash. Shares are counted in parallel; the ``n_features``
n-grams that tell the classes apart best are kept, and the regression runs on the driver over
their places in the bounded sample. Classes count by their size among all labelled rows, so scores
estimate probabilities. All texts are then scored, whole.

Defined results: a null or empty text has no features and gets the score of the intercept.
Repeated rows are learned once and scored each; a null id is not held out and not learned; an id
with contradicting labels counts as toxic. Without rows of both classes every score is the share
of toxic rows (0 without any). Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dripline.llm.grams import code_points, gram_buckets
from dripline.llm.support import (
    collect_sorted,
    fold,
    held_out,
    labelled_sample,
    ship,
    strings,
)
from dripline.session import materialize

SIZES = (4, 6, 8)
BITS = 19
PER_CLASS = 4_000
N_FEATURES = 5_000
LEAST_TEXTS = 5
SMOOTHING = 1.0
PENALTY = 1e-3
STEPS = 200
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5


def buckets_of(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text, with repetition; white space counts as one space."""
    return gram_buckets(code_points(f" {' '.join(text.split())} "), SIZES, BITS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    """``feature`` numbers the kept buckets (0: not kept); ``weight`` is ratio times weight."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def features(self, text: str) -> np.ndarray:
        """The numbers of the kept n-grams that a text holds, each once."""
        found = self.feature[buckets_of(text)]
        return np.unique(found[found > 0])

    def score(self, text: str) -> float:
        margin = self.intercept + self.weight[self.features(text)].sum()
        return float(sigmoid(np.array(margin)))


def logistic(
    rows: list[np.ndarray], target: np.ndarray, importance: np.ndarray, scale: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and intercept, by accelerated gradient descent.

    ``rows`` has the feature numbers of each text. The step is one over the largest curvature that
    the loss can have, found by power iteration.
    """
    place = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    importance = importance / importance.sum()
    n, size = len(rows), len(scale)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, (scale * w)[place], minlength=n)

    def pulled(g: np.ndarray) -> np.ndarray:
        return scale * np.bincount(place, g[owner], minlength=size)

    direction = np.ones(size) / np.sqrt(size)
    curvature = 1.0
    for _ in range(15):
        image = pulled(importance * margins(direction))
        curvature = float(np.linalg.norm(image)) or 1.0
        direction = image / curvature
    step = 1.0 / (0.25 * (curvature + 1.0) * 1.1 + PENALTY)
    w = previous = np.zeros(size)
    share = float((importance * target).sum())
    b = previous_b = float(np.log(share / (1 - share)))
    for t in range(STEPS):
        ahead = w + (t / (t + 3)) * (w - previous)
        ahead_b = b + (t / (t + 3)) * (b - previous_b)
        error = importance * (sigmoid(margins(ahead) + ahead_b) - target)
        previous, previous_b = w, b
        w = ahead - step * (pulled(error) + PENALTY * ahead)
        b = ahead_b - step * float(error.sum())
    return w, b


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    n_features: int = N_FEATURES,
) -> Model:
    none = Model(np.zeros(1 << BITS, np.int32), np.zeros(1), -np.inf)
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
    if not totals.get(1):
        return none
    if not totals.get(0):
        return Model(none.feature, none.weight, np.inf)
    sample = materialize(
        labelled_sample(documents, labels, label, FOLDS, HELD_OUT, per_class)
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        n = [0, 0]
        for batch in batches:
            for one, text in zip(
                batch.column("label").to_pylist(), strings(batch.column("text")), strict=True
            ):
                n[one] += 1
                seen[one, np.unique(buckets_of(text))] += 1
        for one in (0, 1):
            at = np.flatnonzero(seen[one])
            yield pa.RecordBatch.from_arrays(
                [
                    # Bucket -1 counts the texts.
                    pa.array(np.append(at, -1)),
                    pa.array(np.full(len(at) + 1, one, dtype=np.int32)),
                    pa.array(np.append(seen[one, at], n[one])),
                ],
                names=["bucket", "label", "n"],
            )

    # At most two rows for each of the 2 ** BITS buckets reach the driver.
    counted = (
        sample.mapInArrow(frequencies, "bucket long, label int, n long")
        .groupBy("bucket", "label")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    seen = np.zeros((2, 1 << BITS))
    n = np.zeros(2)
    bucket, one, count = (counted.column(x).to_numpy() for x in ("bucket", "label", "n"))
    real = bucket >= 0
    seen[one[real], bucket[real]] = count[real]
    n[one[~real]] = count[~real]
    if not n.all():  # the labelled texts of a class are missing
        return Model(none.feature, none.weight, np.inf if n[1] else -np.inf)
    share = (seen + SMOOTHING) / (n[:, None] + 2 * SMOOTHING)
    ratio = np.log(share[1] / share[0])
    telling = np.abs(share[1] - share[0]) * np.abs(ratio)
    telling[seen.sum(axis=0) < LEAST_TEXTS] = 0.0
    order = np.argsort(-telling, kind="stable")[:n_features]
    order = order[telling[order] > 0]
    feature = np.zeros(1 << BITS, dtype=np.int32)
    feature[order] = np.arange(1, len(order) + 1)
    scale = np.concatenate(([0.0], ratio[order]))
    unfitted = Model(feature, scale, 0.0)
    shared = documents.sparkSession.sparkContext.broadcast(unfitted)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(x) for x in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.string()),
                    batch.column("label"),
                    pa.array(found, pa.list_(pa.int32())),
                ],
                names=["doc_id", "label", "features"],
            )

    rows = collect_sorted(
        sample.mapInArrow(places, "doc_id string, label int, features array<int>"),
        "doc_id",
    )
    target = rows.column("label").to_numpy().astype(float)
    features = [np.asarray(x.values) for x in rows.column("features")]
    weight_of = np.array([totals[0] / n[0], totals[1] / n[1]])
    w, b = logistic(features, target, weight_of[target.astype(int)], scale)
    return Model(feature, scale * w, b)


def scores(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    threshold: float = THRESHOLD,
    **settings,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select("doc_id", "text")
    model = spark.sparkContext.broadcast(fit(docs, labels, label, **settings))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.value.score(x) for x in strings(batch.column("text"))], float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(found, pa.float64()),
                    pa.array((found >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text"
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        score, f"doc_id {id_type}, held_out boolean, score double, predicted int"
    )
