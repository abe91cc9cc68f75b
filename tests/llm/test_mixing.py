import math
import random
import re

import pytest
from pyspark.sql import functions as F

from dripline.llm import mixing
from dripline.llm.mixing import fit_rates, label_domains, mix, with_rate


def members(spark, rows):
    return spark.createDataFrame(rows, "n_tokens long, posterior array<double>")


def drawn(frame, mixture):
    rows = frame.select("*", mixture.rate().alias("rate")).collect()
    k = len(rows[0]["posterior"])
    return [sum(r["n_tokens"] * r["posterior"][d] * r["rate"] for r in rows) for d in range(k)]


def test_targets_are_met_with_rates_near_one(spark):
    rows = [(10 + i % 7, [0.9, 0.1]) for i in range(60)] + [(5, [0.2, 0.8])] * 40 + [(0, [0.5, 0.5])]
    frame = members(spark, rows)
    mixture = fit_rates(frame, ["a", "b"], {"a": 0.6, "b": 0.4})
    total = sum(n for n, _ in rows)
    assert drawn(frame, mixture) == pytest.approx([0.6 * total, 0.4 * total], rel=2e-3)
    # No other rates that meet the targets are nearer to 1: a shift along the constraints is worse.
    rates = [r["rate"] for r in frame.select(mixture.rate().alias("rate")).collect()]
    assert len({round(x, 9) for x in rates}) <= 3 and min(rates) >= 0


def test_rates_stay_at_zero_or_above(spark):
    frame = members(spark, [(10, [1.0, 0.0])] * 20 + [(10, [0.5, 0.5])] * 10 + [(10, [0.0, 1.0])] * 5)
    mixture = fit_rates(frame, ["a", "b"], {"a": 0.02, "b": 0.98}, max_rate=10.0)
    rates = {tuple(r["posterior"]): r["rate"] for r in frame.select("*", mixture.rate().alias("rate")).collect()}
    assert rates[1.0, 0.0] == 0 and rates[0.0, 1.0] > 1
    assert drawn(frame, mixture) == pytest.approx([7.0, 343.0], rel=2e-2)


def test_what_cannot_be_met_ends_at_the_bounds(spark):
    frame = members(spark, [(10, [1.0, 0.0])] * 20 + [(1, [0.0, 1.0])])
    mixture = fit_rates(frame, ["a", "b"], {"a": 0.5, "b": 0.5})
    rates = [r["rate"] for r in frame.select(mixture.rate().alias("rate")).collect()]
    assert 0 <= min(rates) and max(rates) == mixing.MAX_RATE


def test_domains_without_a_target_or_tokens(spark):
    frame = members(spark, [(10, [0.5, 0.5, 0.0])] * 4)
    mixture = fit_rates(frame, ["a", "b", "c"], {"a": 1.0, "c": 0.5, "other": 3.0})
    assert drawn(frame, mixture)[0] == pytest.approx(20, rel=1e-3)
    assert fit_rates(frame.limit(0), ["a", "b", "c"], {"a": 1.0}).pull == [0.0] * 3


def test_posteriors_tell_the_domains_apart(spark):
    labelled, texts = [], []
    for i in range(90):
        kind = ("good", "low", "toxic")[i % 3]
        text = {
            "good": f"plain words about number{i} and more of the same kind",
            "low": f"JUNK!! JUNK!! ### $$$ JUNK{i}!!",
            "toxic": f"plain words about number{i} and an idiot or moron",
        }[kind]
        texts.append((i, text))
        if i < 60:
            labelled.append((i, kind))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame(labelled, "doc_id long, domain string")
    rows = mix(docs, known, {"good": 0.8, "low": 0.1, "toxic": 0.1}).collect()
    for row in rows:
        expected = ("good", "low", "toxic")[row["doc_id"] % 3]
        assert max(row["domains"], key=row["domains"].get) == expected
        assert sum(row["domains"].values()) == pytest.approx(1)
        assert row["n_tokens"] == len(texts[row["doc_id"]][1].split())
    totals = {
        name: sum(row["n_tokens"] * row["domains"][name] * row["rate"] for row in rows)
        for name in ("good", "low", "toxic")
    }
    everything = sum(row["n_tokens"] for row in rows)
    assert totals["good"] == pytest.approx(0.8 * everything, rel=0.01)
    assert totals["toxic"] == pytest.approx(0.1 * everything, rel=0.02)


def test_odd_rows(odd_documents, no_documents, small_labels, no_labels):
    n = odd_documents.count()
    for labels in (small_labels, no_labels):
        rows = mix(odd_documents, label_domains(labels), mixing.TARGETS).collect()
        assert len(rows) == n and all(row["rate"] >= 0 for row in rows)
        kept = with_rate(odd_documents, label_domains(labels), mixing.TARGETS)
        assert kept.columns == [*odd_documents.columns, "mix_rate"]
        assert kept.drop("mix_rate").exceptAll(odd_documents).isEmpty() and kept.count() == n
    assert mix(no_documents, label_domains(small_labels), mixing.TARGETS).collect() == []
    own = odd_documents.withColumn("mix_rate", F.lit(-1.0))
    assert with_rate(own, label_domains(small_labels), mixing.TARGETS).where("mix_rate < 0").isEmpty()


def test_no_python_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = mixing.fit_classifier(docs, label_domains(labels))
    rows = docs.select("doc_id", *(c.alias(n) for n, c in mixing.evidence(F.col("text")).items()))
    plan = classifier.posteriors(rows, "doc_id")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_labels_without_a_document_here_teach_nothing(spark):
    texts = [(i, f"plain words about number{i}") for i in range(40)]
    texts += [(100 + i, f"JUNK!! ### JUNK{i}") for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labelled = [(i, "good" if i < 100 else "low") for i, _ in texts]
    gone = [(1_000 + i, "low") for i in range(500)] + [(5_000, "toxic")]
    schema = "doc_id long, domain string"
    own = mixing.fit_classifier(docs, spark.createDataFrame(labelled, schema), per_domain=20)
    both = mixing.fit_classifier(docs, spark.createDataFrame(labelled + gone, schema), per_domain=20)
    assert both == own and both.domains == ["good", "low"]
    assert both.constant == pytest.approx([math.log(40 / 44), math.log(4 / 44)])


def test_a_scarce_domain_meets_its_target_without_a_cap(spark):
    frame = members(spark, [(10, [1.0, 0.0])] * 20 + [(1, [0.0, 1.0])])
    mixture = fit_rates(frame, ["a", "b"], {"a": 0.5, "b": 0.5}, max_rate=None)
    assert drawn(frame, mixture) == pytest.approx([100.5, 100.5], rel=1e-3)
    assert mixture.wanted == pytest.approx([100.5, 100.5]) and mixture.missed() == {}
    capped = fit_rates(frame, ["a", "b"], {"a": 0.5, "b": 0.5}, max_rate=4.0)
    assert capped.missed()["b"] == pytest.approx((100.5, 4.0))


def test_operators_meet_the_target_of_a_scarce_domain(spark, caplog):
    texts = [(i, f"plain words about number{i} and more of the same kind") for i in range(200)]
    texts += [(500 + i, "JUNK!! JUNK!! ### $$$") for i in range(2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labelled = spark.createDataFrame(
        [(i, "good" if i < 500 else "low") for i, _ in texts], "doc_id long, domain string"
    )
    for operator, name in ((mixing.mixed, "rate"), (mixing.rated, "mix_rate")):
        rows, mixture = operator(docs, labelled, {"good": 0.8, "low": 0.2})
        assert mixture.missed() == {} and mixture.drawn == pytest.approx(mixture.wanted, rel=1e-2)
        assert max(row[name] for row in rows.collect()) > 4
    assert not caplog.records
    mix(docs, labelled, {"good": 0.8, "low": 0.2}, max_rate=1.5)
    assert "target of low missed" in caplog.text


def test_targets_that_few_documents_can_meet(spark):
    generator = random.Random(5)
    rows = []
    for _ in range(300):
        x, y = generator.random() ** 8, generator.random() ** 4
        rows.append((generator.randint(1, 400), [1 - max(x, y), max(x, y) * 0.7, max(x, y) * 0.3]))
    top = sorted(rows, key=lambda row: -row[1][1])[:5]
    asked = [sum(n * p[d] for n, p in top) for d in range(3)]
    frame = members(spark, rows)
    targets = dict(zip("abc", asked))
    mixture = fit_rates(frame, list("abc"), targets, max_rate=None)
    assert mixture.missed() == {}
    rates = [r["rate"] for r in frame.select(mixture.rate().alias("rate")).collect()]
    assert min(rates) == 0 and max(rates) > 4


def test_what_no_rates_can_meet_is_told(spark):
    frame = members(spark, [(10, [0.7, 0.3])] * 20 + [(10, [0.9, 0.1])] * 20)
    mixture = fit_rates(frame, ["a", "b"], {"a": 0.2, "b": 0.8}, max_rate=None)
    assert set(mixture.missed()) == {"a", "b"}
    rates = [r["rate"] for r in frame.select(mixture.rate().alias("rate")).collect()]
    assert min(rates) >= 0 and sum(mixture.drawn) > 0
