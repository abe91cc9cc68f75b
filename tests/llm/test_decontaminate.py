import random
import re

import pytest

from dripline.llm.decontaminate import contamination, find_spans, items_digest, keep_clean

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items):
    """(n_words, n_hit, ids) of each text, window by window."""
    windows = {}
    for item_id, text in items:
        own = words(text)
        size = min(13, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item_id)
    out = []
    for text in documents:
        own, hit, ids = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(own) - size + 1):
                found = windows.get(tuple(own[i : i + size]))
                if found is not None:
                    ids |= found
                    hit.update(range(i, i + size))
        out.append((len(own), len(hit), sorted(str(x) for x in ids if x is not None)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    generator = random.Random(5)
    vocabulary = ["ab", "cd", "Ef", "gé", "x1", "zz"]

    def some(n):
        return " ".join(generator.choices(vocabulary, k=n))

    items = [(i, some(generator.choice([1, 2, 5, 12, 13, 14, 30, 60]))) for i in range(25)]
    items += [(7, some(20)), (None, some(15)), (100, None), (101, ""), (102, "...")]
    documents = [None, "", "...", "ab"]
    for _ in range(60):
        parts = [some(generator.randint(0, 40))]
        for _ in range(generator.randint(0, 3)):
            piece = words(generator.choice(items)[1])
            cut = generator.randint(0, len(piece))
            parts += [", ".join(piece[cut - 13 if cut > 13 else 0 : cut + 13]), some(6)]
        documents.append("! ".join(parts))
    rows = [(i, text) for i, text in enumerate(documents)] + [(4, documents[8]), (None, documents[9])]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        items,
    )


@pytest.mark.parametrize("block_words", [1_000_000, 120])
def test_random_texts_against_brute_force(tables, block_words):
    documents, benchmark, items = tables
    rows = documents.collect()
    expected = sorted(
        zip([str(row["doc_id"]) for row in rows], brute([r["text"] for r in rows], items), strict=True)
    )
    found = find_spans(documents, benchmark, block_words=block_words).collect()
    got = []
    for row in found:
        runs = list(zip(row["spans"][::2], row["spans"][1::2], strict=True))
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
        n_hit = sum(end - start for start, end in runs)
        got.append((str(row["doc_id"]), (row["n_words"], n_hit, row["items"])))
    assert sorted(got) == expected


@pytest.mark.parametrize("block_words", [1_000_000, 120])
def test_clean_documents_stay(tables, block_words):
    documents, benchmark, _ = tables
    judged = contamination(documents, benchmark, block_words=block_words)
    bad = judged.where("contaminated").count()
    kept = keep_clean(documents, benchmark, block_words=block_words)
    assert kept.columns == documents.columns
    assert 0 < bad < documents.count() and kept.count() == documents.count() - bad


def test_odd_rows(spark, odd_documents, no_documents, tables):
    _, benchmark, _ = tables
    rows = contamination(odd_documents, benchmark).collect()
    assert len(rows) == odd_documents.count()
    assert all(row["items_sha256"] == items_digest([]) for row in rows if row["n_items"] == 0)
    assert contamination(no_documents, benchmark).collect() == []
    none = contamination(odd_documents, benchmark.limit(0))
    assert none.where("contaminated OR n_hit > 0").isEmpty()
    assert keep_clean(odd_documents, benchmark.limit(0)).columns == odd_documents.columns
    extra = benchmark.selectExpr("*", "1 AS spans", "2 AS doc_id", "3 AS digest")
    assert contamination(odd_documents, extra).count() == len(rows)
