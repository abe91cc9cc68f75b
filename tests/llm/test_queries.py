"""All text queries over whole small tables, against SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from dripline.llm.oracle import ORACLE_SQL
from dripline.llm.queries import ALL_QUERIES, QUERIES
from verification.compare import _canonical

ONE_ROW_EACH = [name for name in QUERIES if name not in ("op7_chat_formatting", "op13_packing")]


def test_registered():
    assert ALL_QUERIES.items() <= contract.queries().items()
    assert ORACLE_SQL.items() <= contract.oracle_sql().items()
    numbers = sorted(int(name.split("_")[0].removeprefix("op")) for name in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {name: query(spark, sf_dir).toPandas() for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(results, sf_dir, name):
    with duckdb.connect() as connection:
        for table in ("documents", "benchmark", "conversations"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        expected = connection.execute(ORACLE_SQL[name]).df()
    found = results[name]
    assert sorted(found.columns) == sorted(expected.columns)
    assert _canonical(found) == _canonical(expected)


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_document(spark, sf_dir, results, name):
    ids = [row[0] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(results[name]["doc_id"]) == sorted(ids)


def test_pipeline(spark, sf_dir, results):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*documents.columns, "mix_rate"]
    rows = {row["doc_id"]: row for row in out.collect()}
    quality = results["op4_quality_classifier"].set_index("doc_id")["predicted"]
    dirty = results["op9_benchmark_decontamination"].set_index("doc_id")["contaminated"]
    secret = results["op1_secret_scans"].set_index("doc_id")["spans"]
    originals = {row["doc_id"]: row["text"] for row in documents.collect()}
    assert len(rows) == out.count() > 0.5 * len(originals)
    for doc_id, row in rows.items():
        assert quality[doc_id] == 1 and not dirty[doc_id]
        assert (row["text"] == originals[doc_id]) == (secret[doc_id] == "")
        assert row["mix_rate"] >= 0 and row["n_chars"] == len(row["text"])
    # What is missing was rejected, is contaminated, or has a nearer copy that was judged first.
    groups = results["op5_ngram_jaccard_join"].set_index("doc_id")["component_id"]
    alone = groups.value_counts()
    for doc_id in set(originals) - set(rows):
        assert quality[doc_id] == 0 or dirty[doc_id] or alone[groups[doc_id]] > 1


def test_stages_of_odd_rows(spark, sf_dir, odd_documents, no_documents):
    folder = sf_dir
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            expected = [*docs.columns, "mix_rate"] if name == "mixing" else docs.columns
            assert out.columns == expected
            assert out.count() <= docs.count()
