import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from dripline.llm.merkle import FIELDS, manifest, reduce_runs
from dripline.llm.queries import merkle_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    texts = [None if row[x] is None else str(row[x]) for x in FIELDS]
    return h(*("-" if x is None else f"{len(x.encode())}:{x}" for x in texts))


def tree(digests):
    """All levels of the tree over some digests."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([h(*own[i : i + 8]) for i in range(0, len(own), 8)])
    return levels


def ways(levels, place):
    out = []
    for level in levels[:-1]:
        first = place - place % 8
        run = level[first : first + 8]
        out.append((run[: place % 8], run[place % 8 + 1 :]))
        place //= 8
    return out


def brute(rows, presented):
    """Expected rows by plain loops, as a sorted list."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        own = by_lang[lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append(tree([leaf_of(r) for r in own]))
    top = tree([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for i, lang in enumerate(order):
        for place, row in enumerate(by_lang[lang]):
            way = ways(trees[i], place) + ways(top, i)
            at = leaf_of(presented(row))
            for left, right in way:
                at = h(*left, at, *right)
            proof = [x for left, right in way for x in left + right]
            out.append(
                (row["doc_id"], leaf_of(row), trees[i][-1][0], root, h(*proof), at, at == root)
            )
    return sorted(out, key=str)


def lowered(row):
    row = row.asDict()
    if row["doc_id"] is not None and row["text"] is not None:
        if zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
            upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            row["text"] = row["text"].translate(str.maketrans(upper, upper.lower()))
    return row


def presented_text():
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return {"text": text}


def corpus(spark, sizes, seed=1):
    generator = random.Random(seed)
    rows = []
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((generator.randrange(10**6), f"Some Text {generator.random()}", lang, "s", 3))
    generator.shuffle(rows)
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(5)


@pytest.mark.parametrize(
    ("sizes", "levels"),
    [
        ({"en": 1}, 3),
        ({"en": 8, "de": 9, None: 1, "": 2}, 1),
        ({"en": 600, "de": 64, "é": 65, "z": 513, "zz": 3}, 1),
        ({"en": 600, "de": 512, "fr": 513, None: 70}, 3),
        ({f"l{i}": 1 + i % 3 for i in range(70)}, 1),
    ],
)
def test_against_plain_loops(spark, sizes, levels):
    docs = corpus(spark, sizes)
    found = manifest(docs, presented=presented_text(), levels=levels).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs.collect(), lowered)
    assert not all(row["verified"] for row in found) or len(found) < 5


def test_odd_rows(spark, odd_documents, no_documents):
    found = manifest(odd_documents, presented=presented_text()).collect()
    assert sorted(map(tuple, found), key=str) == brute(odd_documents.collect(), lowered)
    assert manifest(no_documents).collect() == []


def test_untouched_rows_verify_and_large_ids_stay_whole(spark):
    rows = [(2**62 + 1, "a", "en", None, None), (None, "b", "en", None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    found = manifest(docs, proofs=True).collect()
    assert {row["doc_id"] for row in found} == {2**62 + 1, None}
    assert all(row["verified"] for row in found)
    for row in found:
        assert h(*row["proof"]) == row["proof_sha256"] and len(row["proof"]) == 1


def test_what_is_presented_as_null_is_not_the_original(spark):
    docs = corpus(spark, {"en": 20})
    found = manifest(docs, presented={"text": F.lit(None).cast("string")}).collect()
    assert not any(row["verified"] for row in found)


def test_a_large_tree_keeps_the_height_of_its_superblocks():
    digests = [h(str(i)) for i in range(9)]
    assert reduce_runs(digests, 9, 2)[0] == tree(digests)[-1][0]
    assert len(reduce_runs(digests[:1], 65, 2)[1]) == 2


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = merkle_manifest(spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, lowered)
