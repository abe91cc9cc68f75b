import random
from collections import Counter
from hashlib import sha256

import pytest

from dripline.llm.alignment import Aligner, align
from dripline.llm.queries import QUERIES, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, ByteLevel(), sentencepiece.SentencePieceProcessor(model_file=B)


def character_bytes():
    table, n = {}, 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            table[chr(x)] = x
    for x in range(256):
        if chr(x) not in table or table[chr(x)] != x:
            table[chr(256 + n)] = x
            n += 1
    return table


TABLE = character_bytes()


def spelled(tools, text):
    """(id, bytes) of the tokens of both kinds, or None if they spell something else."""
    tokenizer, _, model = tools
    own = tokenizer.encode(f" {text}", add_special_tokens=False)
    a = [(i, bytes(TABLE[c] for c in x)) for i, x in zip(own.ids, own.tokens, strict=True)]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        if piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6:
            b.append((i, bytes.fromhex(piece[3:5])))
        else:
            b.append((i, piece.replace("▁", " ").encode()))
    whole = f" {text}".encode()
    if not text or any(b"".join(x for _, x in own) != whole for own in (a, b)):
        return None
    return a, b


def spans(tokens):
    at = 0
    for i, own in tokens:
        yield i, at, at + len(own)
        at += len(own)


def brute(tools, texts):
    """Expected rows in the order of the texts, by comparing all pairs of tokens."""
    docs, counts = [], Counter()
    for text in texts:
        both = spelled(tools, text or "")
        if both is None:
            docs.append(None)
            continue
        a, b = (list(spans(x)) for x in both)
        links = [
            (x, y) for x, low, high in a for y, other_low, other_high in b
            if max(low, other_low) < min(high, other_high)
        ]
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(
                ",".join(str(i) for i, s, e in own if low <= s and e <= end) for own in (a, b)
            ))
            low = end
        counts.update(set(links))
        docs.append((len(a), len(b), len(ends), links, ";".join(groups)))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = doc
        out.append((
            n_a, n_b, n_groups, len(links),
            sum(counts[x] == best[x[0]] for x in links),
            sum(counts[x] for x in links),
            sha256(groups.encode()).hexdigest(),
        ))
    return out


def random_texts(n=80, seed=2):
    generator = random.Random(seed)
    words = ["the", "quick", "naïve", "中文字", "😀", "it's", "tokenizer", "don't", "12", "3.14", "—", "\n",
             "  ", "Ünïcödé", "<s>", "</s>", "<0x41>", "<|endoftext|>", "\x00", "ﬁ", "é", "xqzk"]
    texts = [" ".join(generator.choices(words, k=generator.randint(1, 15))) for _ in range(n)]
    return [*texts, *texts[:20], texts[0], None, "", " ", "▁a", "a▁", "\t", " a", "a ", "½"]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("table_size", [1 << 20, 40, 0])
def test_against_all_pairs_of_tokens(spark, tools, table_size):
    texts = random_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = brute(tools, texts)
    assert sum(x[0] == 0 for x in expected) < 10 and len({x[5] for x in expected}) > 40
    rows = align(docs, A, B, table_size=table_size).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row[x] for x in NAMES) == expected[row["doc_id"]], texts[row["doc_id"]]


def test_hot_texts_and_others(spark, tools):
    # One text holds most rows, two thousand others are below the share that counts as hot.
    texts = ["the hot text"] * 4000 + [f"cold {i}" for i in range(2000)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    distinct = ["the hot text"] + [f"cold {i}" for i in range(2000)]
    measures = dict(zip(distinct, [x[:4] for x in brute(tools, distinct)], strict=True))
    rows = align(docs, A, B).collect()
    assert sorted(row["doc_id"] for row in rows) == list(range(len(texts)))
    for row in rows:
        found = tuple(row[x] for x in NAMES[:4])
        assert found == measures.get(texts[row["doc_id"]], (0, 0, 0, 0))


def test_groups_of_one_text(tools):
    (found,) = Aligner(A, B).align(["naïve 中 it's"])
    groups = found.groups.split(";")
    assert len(groups) == found.n_groups
    ids_a = [int(x) for g in groups for x in g.split("|")[0].split(",")]
    ids_b = [int(x) for g in groups for x in g.split("|")[1].split(",")]
    a, b = spelled(tools, "naïve 中 it's")
    assert (ids_a, ids_b) == ([i for i, _ in a], [i for i, _ in b])
    assert found.times.sum() == found.n_links == found.n_a + found.n_b - found.n_groups


def test_odd_rows(spark, odd_documents, no_documents):
    rows = align(odd_documents, A, B).collect()
    assert len(rows) == odd_documents.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(
        str(r["doc_id"]) for r in odd_documents.collect()
    )
    assert align(no_documents, A, B).collect() == []


def test_query(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.where("length(text) < 1500 or text is null")
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    expected = dict(zip(texts, brute(tools, list(texts.values())), strict=True))
    for row in align(short, A, B).collect():
        assert tuple(row[x] for x in NAMES) == expected[row["doc_id"]]
    rows = QUERIES["op12_token_alignment"](spark, sf_dir).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]
        if row["doc_id"] in expected:
            assert tuple(row[x] for x in NAMES[:4]) == expected[row["doc_id"]][:4]
            assert row["groups_sha256"] == expected[row["doc_id"]][6]


def test_cached_ids_are_those_of_the_library(tools):
    tokenizer, _, _ = tools
    generator = random.Random(9)
    letters = "ab'sStT 01,.!?-\t\n\r\x0b\x1c\x85\xa0ßéǅİ€中😀²½ªÂ ſ’—Ж<|>endoftxtary  "
    texts = ["".join(generator.choices(letters, k=generator.randint(0, 40))) for _ in range(3000)]
    texts += [f" {chr(i)} a{chr(i)}b{chr(i)}'{chr(i)}s 1{chr(i)}\n{chr(i)}" for i in range(1, 0x260)]
    texts += ["a<|endoftext|>b", "it's  I'll\n\n\nwe", "   ", ""]
    words = Aligner(A, B).a
    expected = [tokenizer.encode(f" {x}", add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        assert [x.tolist() for x in words.encode(texts)] == expected
