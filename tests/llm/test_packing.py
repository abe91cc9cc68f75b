import random
import zlib

import numpy as np
import pytest
from hypothesis import given, strategies as st

from dripline.llm import packing
from dripline.llm.packing import IdEncoder, RoomTree, first_fit_decreasing, pack, pack_lengths
from dripline.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [x.ids + [2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def padding(used, length):
    return 0 if used & (used - 1) == 0 else length - used


@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_decreasing_against_a_plain_search(lengths):
    bins = []
    for size in sorted(lengths, reverse=True):
        place = next((b for b in bins if sum(b) + size <= 64), None)
        if place is None:
            bins.append([size])
        else:
            place.append(size)
    found = first_fit_decreasing(lengths, 64)
    assert [[p.length for p in pieces] for pieces in found] == bins
    assert sorted(p.item for pieces in found for p in pieces) == list(range(len(lengths)))


def test_room_tree():
    tree = RoomTree(5, 10)
    assert [tree.first_fit(x) for x in (6, 6, 4, 4, 10, 1)] == [0, 1, 0, 1, 2, 3]


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(0, 20))
def test_every_id_lies_in_one_piece_and_padding_is_bounded(lengths, most):
    sequences = pack_lengths(lengths, 100, most)
    covered = sorted((p.item, p.start, p.length) for pieces in sequences for p in pieces)
    place = {}
    for item, start, size in covered:
        assert size > 0 and start == place.get(item, 0)
        place[item] = start + size
    assert [place[i] for i in range(len(lengths))] == lengths
    for pieces in sequences:
        used = sum(p.length for p in pieces)
        assert 0 < used <= 100 and padding(used, 100) <= most


def test_ids_are_those_of_the_library():
    generator = random.Random(5)
    letters = "ab'sStT 01,.!?-\t\n\x1c\x85ßéǅİ€中😀ſ’—Ж<|>endoftxtary"
    texts = ["".join(generator.choices(letters, k=generator.randint(0, 40))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "", " ", "J̌ J̌b", "Привет — мир", "same same"]
    own = IdEncoder(PATH, cache_size=500)
    for _ in range(2):
        found = own.encode(texts)
        assert [np.frombuffer(x, own.dtype).tolist() + [2] for x in found] == library_ids(texts)


def check(rows, texts, length):
    """Pieces against the library's ids, one list of ids for each row of the table."""
    ids = library_ids(texts)
    wanted = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)
    pieces, sequences = {}, {}
    for row in rows:
        assert row["length"] * 4 == len(row["ids"])
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
        pieces.setdefault(row["doc_id"], []).append(row)
    joined = []
    for own in pieces.values():
        own.sort(key=lambda r: (r["start"], r["length"]))
        joined.append(b"".join(r["ids"] for r in own))
        at = 0
        for row in own:
            assert row["start"] == at and row["doc_tokens"] == sum(r["length"] for r in own)
            at += row["length"]
    assert sorted((len(x) // 4, zlib.crc32(x)) for x in joined) == wanted
    lost = 0
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
        lost += padding(at, length)
    return lost


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {row["doc_id"]: row["text"] or "" for row in docs.collect()}
    for settings in ({}, {"group_docs": 20, "most_padding": 0}, {"length": 96}):
        rows = pack(docs.repartition(3), PATH, **settings).collect()
        length = settings.get("length", 4096)
        lost = check(rows, list(texts.values()), length)
        total = sum(row["length"] for row in rows)
        assert lost <= 0.005 * total if length > 96 else lost <= 16 * total / 80
        assert lost == 0 or settings.get("most_padding") != 0


def test_query(spark, sf_dir):
    rows = QUERIES["op13_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = dict(zip((d["doc_id"] for d in docs), library_ids([d["text"] or "" for d in docs]), strict=True))
    assert {row["doc_id"] for row in rows} == set(ids)
    assert sum(row["length"] for row in rows) == sum(map(len, ids.values()))
    for row in rows:
        own = ids[row["doc_id"]]
        assert row["doc_tokens"] == len(own)
        own = own[row["start"] : row["start"] + row["length"]]
        assert len(own) == row["length"]
        assert row["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())


def test_odd_rows(spark, odd_documents, no_documents):
    rows = pack(odd_documents, PATH, group_docs=3).collect()
    texts = [row["text"] or "" for row in odd_documents.collect()]
    assert sum(row["length"] for row in rows) == sum(map(len, library_ids(texts)))
    # Rows with ids of their own, one of them far longer than a sequence.
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pack(numbered, PATH, group_docs=3).collect(), texts, 4096)
    assert pack(no_documents, PATH).collect() == []


def test_a_hot_id_spreads_over_groups(spark):
    rows = [(None if i % 3 else i, f"word{i} " * 40) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = pack(docs, PATH, group_docs=50, length=512).collect()
    groups = {row["sequence_id"] >> 25 for row in found if row["doc_id"] is None}
    assert len(groups) >= 10


@pytest.mark.parametrize("sizes", [[], [1], [4096], [4095], [1] * 5000])
def test_edges(sizes):
    sequences = packing.pack_lengths(sizes)
    assert sum(p.length for pieces in sequences for p in pieces) == sum(sizes)
