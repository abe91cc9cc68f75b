"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams of words, the one with the smallest hash is a
fingerprint. Two texts that share ``window`` consecutive words share those k-grams, hence the
fingerprint among them. So it is enough to look up the fingerprints of a document (about a fifth
of its k-grams) among those of the benchmark, and to extend each hit word by word: every shared
run of ``window`` words or more is found, and nothing shorter counts.

The benchmark is the small side. It is cut into blocks of a bounded number of words, and every
block meets all documents in one pass without a shuffle. With more than one block the findings
of the passes, which only contaminated texts have, are merged by the digest of the text.

Defined results: a null or empty text has no words, no hits and no items. An item without words
matches nothing. An item with fewer than ``window`` words is one window. Rows are judged one by
one, so repeated rows give repeated results and a null id stays null. Items with the same id
count once; the words of an item without id count as hit, the item itself isn't listed. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dripline.llm.support import (
    LETTER_OR_DIGIT,
    HashSet,
    gram_hashes,
    sequence_hash,
    ship,
    text_chunks,
    word_hashes,
)

WINDOW = 13
GRAM = 5
BLOCK_WORDS = 2_000_000

_FINDINGS = "n_words long, spans array<int>, items array<string>"


def fingerprint_places(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of every ``span`` consecutive ones."""
    if len(grams) < span:
        return np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    last = len(grams) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1))
    return np.unique(last)


@dataclass
class BenchmarkBlock:
    """Word hashes of some items, their fingerprints, and their short items by length."""

    words: np.ndarray
    bounds: np.ndarray
    ids: list[str | None]
    prints: np.ndarray
    print_places: np.ndarray
    known: HashSet
    short: dict[int, dict[int, list[int]]]
    known_short: dict[int, HashSet]
    window: int
    k: int

    def item_at(self, place: int) -> int:
        return int(np.searchsorted(self.bounds, place, side="right")) - 1


def build_block(rows: list[tuple[str | None, str | None]], window: int, k: int) -> BenchmarkBlock:
    hashes, ids = [], []
    texts = pa.array([text for _, text in rows], pa.large_string())
    for chunk in text_chunks(texts):
        words = word_hashes(chunk, LETTER_OR_DIGIT)
        hashes += [words.of(i) for i in range(len(chunk))]
    ids = [None if item_id is None else str(item_id) for item_id, _ in rows]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in hashes]))).astype(np.int64)
    places, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    short: dict[int, dict[int, list[int]]] = {}
    for i, item in enumerate(hashes):
        if 0 < len(item) < window:
            # Within one length, the hash of the sequence finds the item.
            found = short.setdefault(len(item), {})
            found.setdefault(int(gram_hashes(item, len(item))[0]), []).append(i)
        elif len(item) >= window:
            grams = gram_hashes(item, k)
            at = fingerprint_places(grams, window - k + 1)
            places.append(at + bounds[i])
            prints.append(grams[at])
    all_prints, all_places = np.concatenate(prints), np.concatenate(places)
    order = np.argsort(all_prints, kind="stable")
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return BenchmarkBlock(
        words=words,
        bounds=bounds,
        ids=ids,
        prints=all_prints[order],
        print_places=all_places[order],
        known=HashSet(all_prints),
        short=short,
        known_short={
            length: HashSet(np.fromiter(found, dtype=np.uint64, count=len(found)))
            for length, found in short.items()
        },
        window=window,
        k=k,
    )


def _same_before(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the ends of two arrays are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    return n if len(differ) == 0 else n - 1 - int(differ[-1])


def _same_after(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return n if len(differ) == 0 else int(differ[0])


def _extended(
    doc: np.ndarray, hits: Iterator[tuple[int, int]], block: BenchmarkBlock
) -> tuple[list[tuple[int, int]], set[int]]:
    """Runs of at least a window of words shared around each (place in text, in block)."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    seen: dict[int, int] = {}
    for place, item_place in hits:
        shift = item_place - place
        if seen.get(shift, -1) > place:  # inside a run that is known
            continue
        item = block.item_at(item_place)
        low, high = block.bounds[item], block.bounds[item + 1]
        before = _same_before(doc[:place], block.words[low:item_place])
        after = _same_after(doc[place:], block.words[item_place:high])
        seen[shift] = place + max(after, 1)
        if before + after >= block.window:
            spans.append((place - before, place + after))
            items.add(item)
    return spans, items


def find_in_texts(column: pa.Array, block: BenchmarkBlock) -> Iterator[tuple[int, list, list]]:
    """For each text: number of words, hit (start, end) runs of words, ids of items found."""
    k, span = block.k, block.window - block.k + 1
    for chunk in text_chunks(column):
        words = word_hashes(chunk, LETTER_OR_DIGIT)
        hits: dict[int, list[tuple[int, int]]] = {}
        # Windows over the edge of a text only add fingerprints; extending settles every hit.
        grams = gram_hashes(words.hashes, k)
        at = fingerprint_places(grams, span)
        at = at[block.known.holds(grams[at])]
        owner = np.searchsorted(words.bounds, at, side="right") - 1
        inside = at + k <= words.bounds[owner + 1]
        at, owner = at[inside], owner[inside]
        low = np.searchsorted(block.prints, grams[at], side="left")
        high = np.searchsorted(block.prints, grams[at], side="right")
        for place, i, a, b in zip(at.tolist(), owner.tolist(), low, high, strict=True):
            own_place = place - int(words.bounds[i])
            hits.setdefault(i, []).extend(
                (own_place, int(there)) for there in block.print_places[a:b]
            )
        shorts: dict[int, list[tuple[int, int, int]]] = {}
        for length, table in block.short.items():
            own = gram_hashes(words.hashes, length)
            at = np.flatnonzero(block.known_short[length].holds(own))
            owner = np.searchsorted(words.bounds, at, side="right") - 1
            for place, i in zip(at, owner, strict=True):
                if place + length <= words.bounds[i + 1]:
                    for item in table[int(own[place])]:
                        shorts.setdefault(int(i), []).append(
                            (int(place - words.bounds[i]), length, item)
                        )
        for i in range(len(chunk)):
            doc = words.of(i)
            spans, items = _extended(doc, iter(hits.get(i, ())), block)
            for place, length, item in shorts.get(i, ()):
                low = block.bounds[item]
                if np.array_equal(doc[place : place + length], block.words[low : low + length]):
                    spans.append((place, place + length))
                    items.add(item)
            named = {block.ids[item] for item in items} - {None}
            yield len(doc), merged(spans), sorted(named)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, end) runs, as disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def in_blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """(item_id, text) of the benchmark, and into how many blocks it has to be cut."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")
    )
    # Words are at least a byte and a separator apart.
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    return items, 1 + int(size // block_words)


def find_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    k: int = GRAM,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, spans, items) of each document.

    ``spans`` holds start, end, start, end ... of the disjoint runs of hit words; ``items`` the
    ids found, sorted as text. ``block_words`` bounds what the driver holds and sends at a time.
    """
    ship(documents.sparkSession)
    items, n_blocks = in_blocks(benchmark, block_words)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if n_blocks == 1:
        return _pass(docs, items, window, k, f"doc_id {id_type}")
    keyed = docs.select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text"
    )
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    findings = None
    for number in range(n_blocks):
        found = _pass(keyed, items.where(block_of == number), window, k, "digest string")
        found = found.where(F.size("spans") > 0).dropDuplicates(["digest"])
        findings = found if findings is None else findings.unionByName(found)
    words = _pass(keyed, items.limit(0), window, k, f"doc_id {id_type}, digest string")
    gathered = findings.groupBy("digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    united = gathered.mapInArrow(_unite, "digest string, spans array<int>, items array<string>")
    empty = F.expr("array()")
    return words.select("doc_id", "digest", "n_words").join(united, "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("spans", empty.cast("array<int>")).alias("spans"),
        F.coalesce("items", empty.cast("array<string>")).alias("items"),
    )


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for flat in batch.column("spans").to_pylist():
            runs = merged(list(zip(flat[::2], flat[1::2], strict=True)))
            spans.append([x for run in runs for x in run])
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array(spans, pa.list_(pa.int32())), batch.column("items")],
            names=["digest", "spans", "items"],
        )


def _pass(docs: DataFrame, items: DataFrame, window: int, k: int, kept: str) -> DataFrame:
    """One pass of all documents against one block of items."""
    rows = [(row["item_id"], row["text"]) for row in items.collect()]
    block = docs.sparkSession.sparkContext.broadcast(build_block(rows, window, k))
    names = [column.split()[0] for column in kept.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(find_in_texts(batch.column("text"), block.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names]
                + [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(
                        [[x for run in runs for x in run] for _, runs, _ in found],
                        pa.list_(pa.int32()),
                    ),
                    pa.array([ids for _, _, ids in found], pa.list_(pa.string())),
                ],
                names=[*names, "n_words", "spans", "items"],
            )

    return docs.select(*names, "text").mapInArrow(search, f"{kept}, {_FINDINGS}")


def contamination(
    documents: DataFrame, benchmark: DataFrame, share: int = 20, **settings
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least one word in ``share`` is hit.
    """
    found = find_spans(documents, benchmark, **settings)
    n_hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            "n_items",
            F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias(
                "contaminated"
            ),
        )
    )


def keep_clean(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    k: int = GRAM,
    share: int = 20,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Rows are judged where they are. Only with a benchmark of several blocks the digests of the
    contaminated texts are joined to the documents.
    """
    ship(documents.sparkSession)
    items, n_blocks = in_blocks(benchmark, block_words)
    if n_blocks > 1:
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
        names = documents.select(digest.alias("doc_id"), F.col(text).alias("text"))
        judged = contamination(
            names, benchmark, share=share, window=window, k=k, block_words=block_words
        )
        bad = judged.where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
        # The row travels as one struct, so that no column of it can meet a name used here.
        row = F.struct(*(F.col(f"`{name}`") for name in documents.columns))
        kept = documents.select(row.alias("row"), digest.alias("digest"))
        return kept.join(bad, F.col("digest") == F.col("bad"), "left_anti").select("row.*")
    rows = [(row["item_id"], row["text"]) for row in items.collect()]
    block = documents.sparkSession.sparkContext.broadcast(build_block(rows, window, k))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        answers = []
        for n_words, runs, _ in find_in_texts(pa.array(texts, pa.large_string()), block.value):
            n_hit = sum(end - start for start, end in runs)
            answers.append(n_hit == 0 or share * n_hit < n_words)
        return pd.Series(answers, dtype=bool)

    return documents.where(clean(F.col(text)))


def items_digest(ids: list[str]) -> str:
    """What ``items_sha256`` is for these ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
