import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from dripline.llm.support import (
    LETTER_OR_DIGIT,
    NOT_SPACE,
    HashSet,
    fold,
    gram_hashes,
    labelled_sample,
    sequence_hash,
    smallest_by_hash,
    text_chunks,
    word_hashes,
)

PATTERNS = {
    "space": (NOT_SPACE, r"[^\x20\x09-\x0D]+"),
    "letters": (LETTER_OR_DIGIT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


texts = st.lists(
    st.none() | st.text(st.sampled_from(list("abAB zZ09\t\n\x0b\x1c-_'é中😀")), max_size=30), max_size=12
)


@given(texts, st.integers(1, 40))
def test_word_hashes_are_those_of_the_words(column, size):
    for inside, pattern in PATTERNS.values():
        seen, n = {}, 0
        for chunk in text_chunks(pa.array(column, pa.string()), size):
            words = word_hashes(chunk, inside)
            for i in range(len(chunk)):
                expected = re.findall(pattern, lowered(column[chunk.first + i] or ""))
                found = words.of(i).tolist()
                assert len(found) == len(expected)
                assert all(seen.setdefault(a, b) == b for a, b in zip(expected, found, strict=True))
            n += len(chunk)
        assert n == len(column)
        assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_large_strings():
    column = pa.array(["one two", None, "three", "four five six"], pa.large_string()).slice(1, 3)
    counts = [
        len(words.of(i))
        for chunk in text_chunks(column)
        for words in [word_hashes(chunk, NOT_SPACE)]
        for i in range(len(chunk))
    ]
    assert counts == [0, 1, 3]


def test_gram_and_sequence_hashes():
    hashes = np.arange(1, 9, dtype=np.uint64)
    assert len(gram_hashes(hashes, 5)) == 4
    assert len(gram_hashes(hashes[:3], 5)) == 0
    assert gram_hashes(hashes[2:7], 5)[0] == gram_hashes(hashes, 5)[2]
    assert sequence_hash(hashes[:3]) != sequence_hash(hashes[:4])
    assert sequence_hash(hashes[:2]) != sequence_hash(hashes[1::-1])


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.lists(st.integers(0, 2**64 - 1)))
def test_hash_set(inside, asked):
    asked = asked + inside
    found = HashSet(np.array(inside, dtype=np.uint64)).holds(np.array(asked, dtype=np.uint64))
    assert found.tolist() == [x in set(inside) for x in asked]


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("fold")).collect()
    assert all(row["fold"] == zlib.crc32(str(row["id"]).encode()) % 5 for row in rows)


def test_samples_are_bounded_and_repeatable(spark):
    keys = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("kind"))
    keys = keys.union(keys)
    once = smallest_by_hash(keys, "kind", "key", 40)
    assert once.groupBy("kind").count().select("count").distinct().collect() == [(40,)]
    again = smallest_by_hash(keys.repartition(7), "kind", "key", 40)
    assert once.exceptAll(again).isEmpty()
    assert not once.exceptAll(again.limit(100)).isEmpty()


def test_labelled_sample_leaves_held_out_and_null_ids(odd_documents, small_labels):
    rows = labelled_sample(odd_documents, small_labels, "toxic", 5, 0, 10).collect()
    ids = [row["doc_id"] for row in rows]
    assert len(ids) == len(set(ids)) and None not in ids
    assert all(zlib.crc32(str(i).encode()) % 5 != 0 for i in ids)
