"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams of its letters: logarithmic counts times
inverse document frequency, of length one. Each language has several centroids, found by
clustering its sample with spherical k-means, since one language may come in several forms. The
language of the centroid with the largest cosine wins. A text that is farther from its centroid
than nearly all of the sample is marked as rejected.

The model is fitted on a bounded sample: at most ``per_language`` documents with a known language
that are not held out, the smallest by hash. Languages are clustered in parallel, each in one task
on its bounded sample. All texts are then compared with all centroids, whole.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected. Ties
go to the language that comes first in the alphabet. Repeated rows are learned once and predicted
each; a null id is not held out and not learned. Without any labelled row every text is ``und``.
Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dripline.llm.grams import gram_buckets, letter_text
from dripline.llm.support import fold, held_out, ship, smallest_by_hash, strings
from dripline.session import materialize

UNKNOWN = "und"
SIZES = (1, 2, 3)
BITS = 12
PER_LANGUAGE = 600
CLUSTERS = 4
ROUNDS = 8
FOLDS, HELD_OUT = 4, 2
# Share of the sample that lies within the distance at which a text is rejected.
WITHIN = 0.995


def counts_of(text: str) -> np.ndarray | None:
    """Counts of the n-grams of a text by bucket; None without letters."""
    points = letter_text(text)
    if len(points) == 0:
        return None
    return np.bincount(gram_buckets(points, SIZES, BITS), minlength=1 << BITS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    return (weighted / np.linalg.norm(weighted)).astype(np.float32)


def spherical_clusters(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of length one. The first is the common direction; each next start is the vector
    that is worst represented so far."""
    mean = vectors.mean(axis=0)
    centroids = [mean / np.linalg.norm(mean)]
    while len(centroids) < min(k, len(vectors)):
        nearest = (vectors @ np.array(centroids).T).max(axis=1)
        centroids.append(vectors[int(nearest.argmin())])
    centroids = np.array(centroids, dtype=np.float32)
    for _ in range(rounds):
        owner = (vectors @ centroids.T).argmax(axis=1)
        for i in range(len(centroids)):
            members = vectors[owner == i]
            if len(members):
                total = members.sum(axis=0)
                centroids[i] = total / np.linalg.norm(total)
    return centroids


@dataclass
class Model:
    """Centroids (one a row) with their languages, and the cosine below which a text is rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for start in range(0, len(texts), 128):
            own = {
                i: counts
                for i in range(start, min(start + 128, len(texts)))
                if (counts := counts_of(texts[i])) is not None
            }
            if not own:
                continue
            vectors = np.array([vector(counts, self.idf) for counts in own.values()])
            cosines = vectors @ self.centroids.T
            best = cosines.argmax(axis=1)
            for i, j, cosine in zip(own, best, cosines.max(axis=1), strict=True):
                score = float(min(1.0, max(0.0, cosine)))
                out[i] = (self.languages[j], score, bool(cosine < self.least[j]))
        return out


def fit(
    documents: DataFrame,
    per_language: int = PER_LANGUAGE,
    clusters: int = CLUSTERS,
    folds: int = FOLDS,
    remainder: int = HELD_OUT,
) -> Model:
    """Fit on documents with columns doc_id, text and lang."""
    known = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(
        fold(F.col("doc_id"), folds) != remainder
    )
    chosen = smallest_by_hash(known.select("lang", "doc_id"), "lang", "doc_id", per_language)
    sample = materialize(
        # At most per_language ids of each language.
        known.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")
        .groupBy("lang", "doc_id")
        .agg(F.min("text").alias("text"))
    )

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for text in strings(batch.column("text")):
                counts = counts_of(text)
                if counts is not None:
                    n += 1
                    total += counts > 0
        at = np.flatnonzero(total)
        # Bucket -1 counts the texts.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"]
        )

    idf = np.zeros(1 << BITS)
    n_texts = 0
    frequencies = sample.mapInArrow(document_frequencies, "bucket long, n long")
    for row in frequencies.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row["bucket"] < 0:
            n_texts = row["n"]
        else:
            idf[row["bucket"]] = row["n"]
    idf = np.log((1 + n_texts) / (1 + idf)) + 1

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values("doc_id")["text"]
        vectors = [vector(c, idf) for c in map(counts_of, texts) if c is not None]
        if not vectors:
            return pd.DataFrame({"lang": [], "least": [], "centroid": []}, dtype=object)
        vectors = np.array(vectors)
        found = spherical_clusters(vectors, clusters, ROUNDS)
        cosines = vectors @ found.T
        owner = cosines.argmax(axis=1)
        least = [
            float(np.quantile(cosines[owner == i, i], 1 - WITHIN)) if (owner == i).any() else 1.0
            for i in range(len(found))
        ]
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "least": least, "centroid": [x.tolist() for x in found]}
        )

    found = (
        sample.groupBy("lang")
        .applyInPandas(centroids, "lang string, least double, centroid array<float>")
        .collect()
    )
    found.sort(key=lambda row: row["lang"])
    return Model(
        idf=idf,
        centroids=np.array([row["centroid"] for row in found], dtype=np.float32),
        languages=[row["lang"] for row in found],
        least=np.array([row["least"] for row in found]),
    )


def identify(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    clusters: int = CLUSTERS,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each document; score is the cosine."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    model = spark.sparkContext.broadcast(fit(docs, per_language, clusters))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.predict(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text"
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        predict,
        f"doc_id {id_type}, held_out boolean, lang_pred string, score double, rejected boolean",
    )
