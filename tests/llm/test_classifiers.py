"""The three classifiers: accuracy on what was held out, and unusual rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dripline.llm import language, quality_trees, toxicity


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return read("documents"), read("labels")


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_languages(tables):
    documents, _ = tables
    truth = {row["doc_id"]: row["lang"] for row in documents.collect()}
    rows = language.identify(documents).collect()
    assert len(rows) == len(truth)
    assert all(row["held_out"] == (remainder(row["doc_id"], 4) == 2) for row in rows)
    assert all(0 <= row["score"] <= 1 for row in rows)
    held = [row for row in rows if row["held_out"]]
    right = sum(row["lang_pred"] == truth[row["doc_id"]] for row in held)
    assert right / len(held) > 0.97


def test_far_texts_are_rejected(spark, tables):
    documents, _ = tables
    strange = spark.createDataFrame(
        [(-1, "漢字仮名交じり文の例です", None), (-2, "12 34 !", None), (-3, None, None)],
        "doc_id long, text string, lang string",
    )
    both = documents.select("doc_id", "text", "lang").unionByName(strange)
    rows = {r["doc_id"]: r for r in language.identify(both).where("doc_id < 0").collect()}
    assert rows[-1]["rejected"] and rows[-1]["lang_pred"] != "und"
    assert rows[-2]["lang_pred"] == rows[-3]["lang_pred"] == "und" and rows[-3]["score"] == 0


def test_prediction_ignores_other_columns(tables):
    documents, _ = tables
    docs = documents.limit(300)
    first = language.identify(docs).orderBy("doc_id").collect()
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    changed = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert language.identify(changed.withColumn("source", F.lit("x"))).orderBy("doc_id").collect() == first


@pytest.mark.parametrize(
    ("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality_trees, "quality", 0.97)]
)
def test_scores(tables, module, label, least):
    documents, labels = tables
    truth = {row["doc_id"]: row[label] for row in labels.collect()}
    rows = module.scores(documents, labels).collect()
    assert len(rows) == documents.count()
    assert all(row["held_out"] == (remainder(row["doc_id"], 5) == 0) for row in rows)
    threshold = module.THRESHOLD
    for row in rows:
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= threshold)
    held = [row for row in rows if row["held_out"] and row["doc_id"] in truth]
    assert sum(row["predicted"] == truth[row["doc_id"]] for row in held) / len(held) >= least
    again = module.scores(documents.repartition(5), labels.repartition(3))
    close = {row["doc_id"]: row["score"] for row in again.collect()}
    assert all(abs(close[row["doc_id"]] - row["score"]) < 1e-6 for row in rows)


def test_held_out_labels_are_not_learned(tables):
    documents, labels = tables
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = documents.limit(200)
    first = quality_trees.scores(docs, labels).orderBy("doc_id").collect()
    assert quality_trees.scores(docs, changed).orderBy("doc_id").collect() == first


def test_trees_learn_an_interaction():
    generator = np.random.default_rng(0)
    rows = generator.random((4000, 3))
    target = ((rows[:, 0] > 0.3) ^ (rows[:, 1] > 0.6)).astype(float)
    trees = quality_trees.grow(rows[:3000], target[:3000], np.ones(3000))
    scores = trees.scores(rows[3000:])
    assert ((scores > 0.5) == target[3000:]).mean() > 0.97
    one_by_one = [trees.scores(rows[i : i + 1])[0] for i in range(3000, 3020)]
    assert np.allclose(one_by_one, scores[:20])


def test_clusters_find_both_forms():
    generator = np.random.default_rng(1)
    vectors = np.abs(generator.normal(0, 0.05, (60, 8)))
    vectors[:30, 0] += 1
    vectors[30:, 5] += 1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centroids = language.spherical_clusters(vectors, 2, 8)
    assert {int(x.argmax()) for x in centroids} == {0, 5}


@pytest.mark.parametrize("module", [toxicity, quality_trees])
def test_odd_rows(module, odd_documents, no_documents, small_labels, no_labels):
    n = odd_documents.count()
    for labels in (small_labels, no_labels, small_labels.where("doc_id = 1")):
        rows = module.scores(odd_documents, labels).collect()
        assert len(rows) == n and all(0 <= row["score"] <= 1 for row in rows)
        assert all(not row["held_out"] for row in rows if row["doc_id"] is None)
    assert module.scores(no_documents, small_labels).collect() == []


def test_odd_rows_of_languages(odd_documents, no_documents):
    rows = language.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    none = {row["lang_pred"] for row in rows if row["doc_id"] in (3, 4, 5)}
    assert none == {"und"}
    unknown = language.identify(odd_documents.withColumn("lang", F.lit(None).cast("string")))
    assert {row["lang_pred"] for row in unknown.collect()} == {"und"}
    assert language.identify(no_documents).collect() == []
