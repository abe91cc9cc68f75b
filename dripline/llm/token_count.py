"""Token counts by a two-tier lookup, without moving any pre-token.

A BPE tokenizer works on each pre-token alone, so a text's count is the sum over its pre-tokens.
Tier one is a table of the token counts of frequent pre-tokens, broadcast to all workers. Tier
two is a cache that each worker keeps from task to task and fills with the library's own counts.
What white space divides is looked up first, as most of it is one pre-token; only what is new to
the worker is cut further and, if a part is new as well, encoded.

The table is made from a bounded sample (the ``sample_docs`` documents with the smallest hashes;
at most ``table_size`` entries). It decides how often tier two is asked, never a count. A worker
empties its cache when that holds ``cache_size`` entries.

Words and their parts are those of :mod:`dripline.llm.pretokens`, in any script. Only texts with
one of the tokenizer's special strings or with a word that the normal form changes a second time,
and tokenizers with another cut, are encoded whole by the library.

Defined results: a null or empty text has 0 bytes and 0 tokens. Rows are counted one by one:
repeated rows give repeated results, a null id stays null, other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dripline.llm.pretokens import Words
from dripline.llm.support import ship, strings

SAMPLE_DOCS = 2_000
TABLE_SIZE = 50_000
CACHE_SIZE = 1_000_000
LIMIT = 2048
GROUP_CHARS = 1 << 20

# Less than any sum of counts: a text with such a word is encoded whole.
NOT_ALONE = -(1 << 60)


class TokenCounter:
    """Counts the tokens of whole texts with one tokenizer."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.table: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.cache_size = cache_size
        self.cut: Words | None = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        self.cut = Words(path)
        self.whole = lambda texts: [len(x) for x in self.cut.encode(texts)]

    @property
    def by_words(self) -> bool:
        return self.cut is not None and self.cut.by_words

    def words(self, text: str) -> list[str] | None:
        """The normalised words of a text, or None if it has to be encoded whole."""
        return self.cut.of(text) if self.cut else None

    def _learn(self, words: list[str]) -> None:
        """Put the counts of words, and of their pre-tokens, into the cache.

        The count of a word that can't be encoded alone is :data:`NOT_ALONE`.
        """
        cache = self.cache
        cut = {word: self.cut.pieces(word) for word in words}
        new = list({x for pieces in cut.values() for x in pieces or () if x not in cache})
        if new:
            cache.update(zip(new, self.whole(new), strict=True))
        for word, pieces in cut.items():
            cache[word] = NOT_ALONE if pieces is None else sum(map(cache.__getitem__, pieces))

    def count(self, texts: list[str], table: dict[str, int]) -> list[int]:
        """Token counts of whole texts; ``table`` is tier one, which the cache starts from."""
        counts: list[int] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > GROUP_CHARS:
                counts += self._count_group(texts[start : i + 1], table)
                start, size = i + 1, 0
        return counts + self._count_group(texts[start:], table)

    def _count_group(self, texts: list[str], table: dict[str, int]) -> list[int]:
        if self.table is not table or len(self.cache) > self.cache_size:
            self.table, self.cache = table, dict(table)
        cache = self.cache
        cut = [self.words(text) for text in texts]
        known = [None if words is None else list(map(cache.get, words)) for words in cut]
        unknown = {
            word
            for words, counts in zip(cut, known, strict=True)
            if counts and None in counts
            for word, n in zip(words, counts, strict=True)
            if n is None
        }
        if unknown:
            self._learn(list(unknown))
            for i, counts in enumerate(known):
                if counts and None in counts:
                    known[i] = list(map(cache.__getitem__, cut[i]))
        out = [NOT_ALONE if counts is None else sum(counts) for counts in known]
        entire = [i for i, n in enumerate(out) if n < 0]
        if entire:
            for i, n in zip(entire, self.whole([texts[i] for i in entire]), strict=True):
                out[i] = n
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str, cache_size: int = CACHE_SIZE) -> TokenCounter:
    """This worker's counter for a tokenizer; it outlives the tasks that use it."""
    if path not in _counters:
        _counters[path] = TokenCounter(path, cache_size)
    return _counters[path]


def frequent_pieces(
    documents: DataFrame, tokenizer: str, sample_docs: int, table_size: int
) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of the sample."""
    sample = (
        documents.select("doc_id")
        .where(F.col("doc_id").isNotNull())
        .dropDuplicates()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )
    texts = (
        documents.join(F.broadcast(sample), "doc_id", "left_semi").select("text").dropDuplicates()
    )

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in strings(batch.column("text")):
                words = own.words(text)
                if words:
                    seen.update(words)
        pieces: Counter[str] = Counter()
        for word, n in seen.items():
            for piece in own.cut.pieces(word) or ():
                pieces[piece] += n
        top = pieces.most_common(table_size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x for x, _ in top], pa.string()),
                pa.array([n for _, n in top], pa.int64()),
                pa.array(own.whole([x for x, _ in top]) if top else [], pa.int32()),
            ],
            names=["piece", "n", "tokens"],
        )

    # The whole sample is bounded, so one task may hold its distinct pre-tokens. The documents are
    # read by as many tasks as ever; only the sample moves.
    found = texts.repartition(1).mapInArrow(frequent, "piece string, n long, tokens int")
    return {row["piece"]: row["tokens"] for row in found.select("piece", "tokens").collect()}


def token_counts(
    documents: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    sample_docs: int = SAMPLE_DOCS,
    table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document.

    ``tokenizer`` is the path of a vocabulary file on every machine: ``.json`` for the tokenizers
    library, ``.model`` for sentencepiece. Tokens are those of the library without any that mark
    the beginning or end.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = spark.sparkContext.broadcast(
        frequent_pieces(docs, tokenizer, sample_docs, table_size)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer, cache_size)
        for batch in batches:
            texts = strings(batch.column("text"))
            n_tokens = own.count(texts, table.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(
        count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    )
