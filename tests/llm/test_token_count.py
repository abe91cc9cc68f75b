import random

import pytest

from dripline.llm import token_count
from dripline.llm.queries import tokenizer_path
from dripline.llm.token_count import TokenCounter, token_counts

PATH = tokenizer_path("word_bpe_49k.json")


def library_counts(texts, path=PATH):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_count_as_the_library_counts():
    generator = random.Random(3)
    letters = "ab'sStTrRevVmMlLdD 0123,.!?-_\t\n\x0b\r\x85\xa0²½ªßÿéǅİ\x1c\x00€中😀ſḰ<|>endoftxtary"
    texts = ["".join(generator.choices(letters, k=generator.randint(0, 30))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "I'LL we'Re '' 's'", "", " "]
    texts += [f"{chr(i)} a{chr(i)}b{chr(i)}'{chr(i)}s 1{chr(i)}" for i in range(0x260)]
    counter = TokenCounter(PATH)
    assert counter.by_words
    expected = library_counts(texts)
    assert counter.count(texts, {}) == expected
    assert counter.count(texts, {"ab": 1, "s": 1}) == expected  # a table, then a warm cache


def test_a_full_cache_changes_nothing():
    texts = [f"word{i} and thing{i}" for i in range(200)]
    counter = TokenCounter(PATH, cache_size=5)
    groups = [counter.count([x], {}) for x in texts]
    assert [x for group in groups for x in group] == library_counts(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(name):
    texts = ["Hello  wORLD, it's 12 é", "", "a\n\nb"]
    path = tokenizer_path(name)
    if name.endswith(".json"):
        expected = library_counts(texts, path)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(x)) for x in texts]
    assert TokenCounter(path).count(texts, {}) == expected


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    rows = token_counts(docs, PATH, sample_docs=20, table_size=100).collect()
    expected = dict(zip(texts, library_counts(list(texts.values())), strict=True))
    assert {row["doc_id"]: row["n_tokens"] for row in rows} == expected
    for row in rows:
        assert row["n_bytes"] == len(texts[row["doc_id"]].encode())
        assert row["over_limit"] == (row["n_tokens"] > 2048)


def test_odd_rows(odd_documents, no_documents):
    rows = token_counts(odd_documents, PATH).collect()
    texts = [row["text"] or "" for row in odd_documents.collect()]
    assert sorted(row["n_tokens"] for row in rows) == sorted(library_counts(texts))
    assert sorted(row["n_bytes"] for row in rows) == sorted(len(x.encode()) for x in texts)
    assert token_counts(no_documents, PATH).collect() == []


def test_table_is_bounded(odd_documents):
    table = token_count.frequent_pieces(odd_documents, PATH, 3, 7)
    assert len(table) <= 7


def test_every_script_is_looked_up():
    texts = [
        "curly ’ quote, “so” it’s — an em dash…",
        "Привет, МИР! Ещё раз: 12 ½ №5",
        "漢字仮名交じり文の例です。 안녕 하세요 مرحبا بالعالم नमस्ते",
        "décomposé Å ẞ ﬁn",
        " wide　spaces and lines\u0085",
    ]
    counter = TokenCounter(PATH)
    assert all(counter.words(x) for x in texts)
    calls, table = [], {}
    whole = counter.whole
    counter.whole = lambda found: calls.append(list(found)) or whole(found)
    assert counter.count(texts, table) == library_counts(texts)
    assert not any(" " in x for found in calls for x in found)
    n = len(calls)
    assert counter.count(texts, table) == library_counts(texts) and len(calls) == n


def test_words_that_change_twice_are_left_to_the_library():
    texts = ["a J̌b c", "plain", "J̌", "x " * 50 + "J̌"]
    counter = TokenCounter(PATH)
    assert counter.words(texts[0]) == ["a", "ǰb", "c"]
    for _ in range(2):
        assert counter.count(texts, {}) == library_counts(texts)


def test_random_code_points_count_as_the_library_counts():
    generator = random.Random(11)
    points = [i for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    texts = [
        " ".join("".join(map(chr, generator.choices(points, k=3))) + "aB" for _ in range(6))
        for _ in range(3000)
    ]
    assert TokenCounter(PATH).count(texts, {}) == library_counts(texts)
