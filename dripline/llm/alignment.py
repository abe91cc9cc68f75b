"""Aligning the tokens of two tokenizers over the same texts.

1. Equal texts are shuffled together by their full text, and each different text is tokenised and
   aligned once. What it yields counts as often as the text occurs.
2. Both token sequences spell the same bytes, so tokens are intervals. Where a token of A and one
   of B end together, a group ends. Between two neighbouring ends of either kind lies the overlap
   of exactly one pair of tokens: that is a link.
3. Pairs of ids are counted over all documents: each distinct text gives its distinct pairs, summed
   with the text's multiplicity in each task before any shuffle.
4. Every text then needs the counts of its pairs. The ``table_size`` commonest pairs go to all
   workers as arrays of that size at most; the pairs beyond, which are rare by construction, are
   joined by a shuffle. Both give the same counts; only the way differs, for each pair.
5. The measures are joined to the ids by the digest of the text. Texts with more than one in a
   thousand of all rows, at most a thousand texts, are joined by broadcast, so no key is hot; rows
   without tokens need no join.

Defined results: a null or empty text, and one whose tokens spell other bytes than its own behind
a space, has no tokens: zeros, and ``groups_sha256`` is empty. Every row gives a row; a null id
stays null. Columns other than the named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dripline.llm.pretokens import ByteWords
from dripline.llm.support import ship, store, strings

TABLE_SIZE = 1 << 20
CACHE_SIZE = 400_000
HOT_SHARE = 1_000
_GROUP_CHARS = 1 << 19


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, all others have the characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in printable]
    return {chr(x): x for x in printable} | {chr(0x100 + i): x for i, x in enumerate(others)}


class Vocabulary:
    """One tokenizer with the bytes of its tokens; texts are encoded behind a space."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # This kind puts the space before the text itself.
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.spelled = [
                bytes([int(model.id_to_piece(i)[3:5], 16)])
                if model.is_byte(i)
                else model.id_to_piece(i).replace("▁", " ").encode()
                for i in range(model.get_piece_size())
            ]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            tokenizer.no_truncation()
            tokenizer.no_padding()
            stated = json.loads(Path(path).read_text(encoding="utf-8"))
            words = ByteWords(tokenizer, stated, CACHE_SIZE)
            self.encode = lambda texts: words.encode([f" {x}" for x in texts])
            byte = byte_of_character()
            self.spelled = [
                bytes(byte[c] for c in x) if x is not None and all(c in byte for c in x) else b""
                for x in map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))
            ]
        self.spelled = np.array(self.spelled, dtype=object)
        self.lengths = np.array([len(x) for x in self.spelled], dtype=np.int64)
        # How an id is written inside a group, at the end of A's part and at the end of B's.
        self.inside, self.last_a, self.last_b = (
            np.array([f"{i}{end}" for i in range(len(self.spelled))], dtype=object)
            for end in ",|;"
        )


    def spells(self, ids: list[int] | np.ndarray, whole: bytes) -> bool:
        return b"".join(self.spelled[np.asarray(ids, np.int64)].tolist()) == whole


@dataclass
class Alignment:
    """Groups and links of one text. Links are given as distinct pairs (a id << 32 | b id)."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups_sha256: str = ""
    pairs: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)
    groups: str = ""


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Vocabulary(path_a), Vocabulary(path_b)

    def align(self, texts: list[str]) -> Iterator[Alignment]:
        ids = zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True)
        for text, ids_a, ids_b in ids:
            whole = f" {text}".encode()
            if text and self.a.spells(ids_a, whole) and self.b.spells(ids_b, whole):
                yield self._aligned(np.array(ids_a, np.int64), np.array(ids_b, np.int64))
            else:
                yield Alignment()

    def _aligned(self, ids_a: np.ndarray, ids_b: np.ndarray) -> Alignment:
        ends_a = np.cumsum(self.a.lengths[ids_a])
        ends_b = np.cumsum(self.b.lengths[ids_b])
        ends = np.sort(np.concatenate((ends_a, ends_b)))
        ends = ends[np.append(ends[1:] != ends[:-1], True)]
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = ends[(ends_a[in_a] == ends) & (ends_b[in_b] == ends)]
        links = np.sort((ids_a[in_a] << 32) | ids_b[in_b])
        first = np.flatnonzero(np.concatenate(([True], links[1:] != links[:-1])))
        pairs, times = links[first], np.diff(np.append(first, len(links)))
        groups = self._groups(ids_a, ids_b, ends_a, ends_b, both)
        return Alignment(
            len(ids_a),
            len(ids_b),
            len(both),
            len(ends),
            sha256(groups.encode()).hexdigest(),
            pairs,
            times,
            groups,
        )

    def _groups(self, ids_a, ids_b, ends_a, ends_b, both) -> str:
        """``a,a|b;a|b,b``: each token stands behind all groups before its own, and those of B
        behind those of A of the same group."""
        until_a = np.searchsorted(ends_a, both, side="right")
        until_b = np.searchsorted(ends_b, both, side="right")
        before_b = np.concatenate(([0], until_b))
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        out = np.empty(len(ids_a) + len(ids_b), dtype=object)
        out[np.arange(len(ids_a)) + before_b[of_a]] = self.a.inside[ids_a]
        out[np.arange(len(ids_b)) + until_a[of_b]] = self.b.inside[ids_b]
        out[until_a - 1 + before_b[:-1]] = self.a.last_a[ids_a[until_a - 1]]
        out[until_b - 1 + until_a] = self.b.last_b[ids_b[until_b - 1]]
        return "".join(out.tolist())[:-1]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner for two tokenizers; it outlives the tasks that use it."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_ALIGNED = (
    "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, times array<long>"
)


def aligned_texts(
    documents: DataFrame, path_a: str, path_b: str, text: str, groups: bool = False
) -> DataFrame:
    """One row for each distinct text that is not empty: how often it occurs, its measures and its
    distinct pairs with the number of links of each; with ``groups`` also the groups as text."""
    own = F.col(f"`{text}`")
    distinct = (
        documents.where(own.isNotNull() & (own != ""))
        .groupBy(own.alias("text"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "copies", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            texts = strings(batch.column("text"))
            begin = size = 0
            for i, one in enumerate(texts):
                size += len(one)
                if size < _GROUP_CHARS and i + 1 < len(texts):
                    continue
                found = list(both.align(texts[begin : i + 1]))
                columns = [
                    batch.column("key").slice(begin, len(found)),
                    batch.column("copies").slice(begin, len(found)),
                    *(
                        pa.array([getattr(x, name) for x in found], pa.int64())
                        for name in ("n_a", "n_b", "n_groups", "n_links")
                    ),
                    pa.array([x.groups_sha256 for x in found], pa.string()),
                    pa.array([x.pairs for x in found], pa.list_(pa.int64())),
                    pa.array([x.times for x in found], pa.list_(pa.int64())),
                ]
                names = [x.split()[0] for x in _ALIGNED.split(", ")]
                if groups:
                    columns.append(pa.array([x.groups for x in found], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                begin, size = i + 1, 0

    return distinct.mapInArrow(run, _ALIGNED + (", groups string" if groups else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, n_texts, best): how many documents and distinct texts hold a pair linked, and
    whether no pair with the same id of A is in more documents.

    The pairs of one id of A are at most as many as the ids of B.
    """
    counted = (
        aligned.select("copies", F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.sum("copies").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    )
    same_a = Window.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(same_a))


def looked_up(aligned: DataFrame, table: pa.Table) -> DataFrame:
    """The texts with ``n_best`` and ``count_sum`` over the pairs of the table, and the pairs that
    are not in it."""
    order = np.argsort(table.column("pair").to_numpy())
    arrays = [table.column(x).to_numpy()[order] for x in ("pair", "n_docs", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(arrays)
    kept = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy()
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            if len(known):
                at = np.searchsorted(known, pairs)
                at[at == len(known)] = 0
                there = known[at] == pairs
                counts = np.where(there, n_docs[at], 0) * times
                bests = np.where(there & best[at], times, 0)
            else:
                there = np.zeros(len(pairs), bool)
                counts = bests = np.zeros(len(pairs), np.int64)
            missing = np.flatnonzero(~there)
            ends = np.searchsorted(missing, bounds).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(x) for x in kept),
                    *(
                        pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[bounds]))
                        for x in (bests, counts)
                    ),
                    *(
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(x[missing]))
                        for x in (pairs, times)
                    ),
                ],
                names=[*kept, "n_best", "count_sum", "pairs", "times"],
            )

    return aligned.select(*kept, "pairs", "times").mapInArrow(
        run,
        _ALIGNED.replace("pairs array", "n_best long, count_sum long, pairs array"),
    )


def with_counts(aligned: DataFrame, table_size: int) -> DataFrame:
    """(key, copies, ..., n_best, count_sum) of each distinct text."""
    counts = store(pair_counts(aligned), "pairs")
    # The order is total, so the table is the same in every run.
    common = counts.orderBy(F.col("n_texts").desc(), "pair").limit(table_size)
    beyond = counts.count() > table_size
    table = (common if beyond else counts).select("pair", "n_docs", "best").toArrow()
    found = looked_up(aligned, table)
    if not beyond:
        return found.drop("pairs", "times")
    found = store(found, "looked-up")
    rest = (
        found.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
        .select("key", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
        .join(counts, "pair")
        .groupBy("key")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"),
            F.sum(F.col("times") * F.col("n_docs")).alias("rest_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        found.drop("pairs", "times")
        .join(rest, "key", "left")
        .withColumn("n_best", F.col("n_best") + F.coalesce("rest_best", zero))
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("rest_sum", zero))
        .drop("rest_best", "rest_sum")
    )


def align(
    documents: DataFrame,
    path_a: str,
    path_b: str,
    doc_id: str = "doc_id",
    text: str = "text",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    ``path_a`` and ``path_b`` are vocabulary files on every machine: ``.json`` of a byte-level
    vocabulary for the tokenizers library, ``.model`` for sentencepiece.
    """
    ship(documents.sparkSession)
    aligned = store(aligned_texts(documents, path_a, path_b, text), "aligned")
    measures = store(with_counts(aligned, table_size), "measures")
    own = F.col(f"`{text}`")
    keyed = store(
        documents.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.when(own != "", F.unhex(F.sha2(own.cast("binary"), 256))).alias("key"),
        ),
        "keyed",
    )
    total = keyed.count()
    # By the sum of their shares there are fewer than HOT_SHARE of them.
    is_hot = F.col("copies") * HOT_SHARE > total
    hot, others = measures.where(is_hot), measures.where(~is_hot)
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    columns = ["doc_id", *sums, "groups_sha256"]
    zeros = [F.lit(0).cast("long").alias(x) for x in sums]
    empty = keyed.where(F.col("key").isNull()).select(
        "doc_id", *zeros, F.lit("").alias("groups_sha256")
    )
    texts = keyed.where(F.col("key").isNotNull())
    by_broadcast = texts.join(F.broadcast(hot), "key").select(*columns)
    by_shuffle = (
        texts.join(F.broadcast(hot.select("key")), "key", "left_anti")
        .join(others, "key")
        .select(*columns)
    )
    return empty.unionByName(by_broadcast).unionByName(by_shuffle)
