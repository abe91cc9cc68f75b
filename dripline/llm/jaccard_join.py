"""Exact Jaccard similarity join of documents as a join in a metric space.

A document is the set of its distinct five-word shingles (64-bit hashes). With distance 1 - J the
sets form a metric space, and documents link if they are nearer than the radius. There are two
jobs. :func:`link_components` and :func:`keep_one` want only the linked groups, so what a group
holds together needs no further comparison. :func:`link_pairs` and :func:`link_counts` want every
link, so for them groups are left out of all of the following: each class stays its own group.

1. Documents with equal sets are one class; only classes are compared.
2. Regions. A shingle is the centre of a region, to which the sets around it belong. A set lies
   in the regions of its first shingles in one common order, rare shingles first. How many is the
   window that the radius asks for: two linked sets miss few enough of each other's shingles that
   some of their first shingles are the same. So each linked pair meets in a region.
3. Pivots. In every region, in rounds, some classes become pivots: the most central of each of a
   few parts. All classes of the region are compared with them. Before the sets are touched, the
   sizes, the places of the region's shingle in both sets, and the counts of shingles in fixed
   cells bound the distance from below (the triangle inequality for the distances to the cells):
   only pairs inside that window go on.
4. Voronoi cells. Every class first meets the pivot whose windows overlap most with its own: one
   pair for each class, however large the region. Classes that now belong to one group are not
   compared again. Two groups that met then try one pair of theirs, and so on while that joins
   groups; only what still stands apart is compared pair by pair.
5. Recursion. Pivots have met everyone and leave. A region whose remaining classes are in one group
   is done; the others go on with more pivots. Every pair of a region was compared,
   excluded by a bound, or is in one group already: no link between groups is lost.

Documents as the only pivots would not do: unrelated texts are all at distance 1 of each other, so
that the windows of document pivots hold everything. Hence the regions are those of shingles, and
document pivots divide them.

The order of shingles is a matter of speed only. Shingles that several classes of one task share
are counted over all documents; the ``common`` most frequent come last in the order. A shingle
that very many documents share is thus in the window of those only that hold little else.

Defined results: null, empty and word-less texts have an empty set, link with nothing and are
their own component. A text with fewer words than a shingle has its whole sequence as its only
shingle. Every row gives a row; repeated rows and rows with equal ids are nodes of their own, and
only their texts link them. The component is the smallest id of its rows; a null id is larger than
any other and stays null only if no row of the component has an id. Columns other than the named
ones are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dripline.llm.components import components
from dripline.llm.support import (
    NOT_SPACE,
    discard,
    folder_of,
    gathered,
    gram_hashes,
    mix,
    sequence_hash,
    ship,
    shuffles_freed,
    store,
    store_parts,
    text_chunks,
    word_hashes,
)
from dripline.session import work_size

SHINGLE = 5
PERCENT = 75
COMMON = 1 << 19
COUNTED_TOGETHER = 1 << 21
FIRST_PIVOTS = 4
FILTER_BITS = 24

# The regions are built in so many slices at most, each from so many stored bytes of windows at least.
MOST_SLICES = 4
SLICE_BYTES = 1 << 25

# Groups go on trying one pair each while at least one in so many of the pairs joins two.
LEAST_JOINED = 2

_CLASS_SEED, _CHECK_SEED, _CELL_SEED = (np.uint64(x) for x in (0x51, 0xA7, 0xC3))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of each text as sorted distinct hashes."""
    for chunk in text_chunks(column):
        words = word_hashes(chunk, NOT_SPACE)
        grams = gram_hashes(words.hashes, size)
        for i in range(len(chunk)):
            low, high = int(words.bounds[i]), int(words.bounds[i + 1])
            if high - low >= size:
                own = np.sort(grams[low : high - size + 1])
                fresh = np.ones(len(own), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                yield own[fresh]
            elif high > low:
                yield np.array([sequence_hash(words.hashes[low:high])], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_hash(shingles: np.ndarray, seed: np.uint64) -> int:
    """One signed 64-bit number for a whole set."""
    total = mix(shingles ^ seed).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(shingles)) + seed).view(np.int64)[0])


def least_shared(n: int, percent: int) -> int:
    """How many shingles a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def cells_of(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by cell. The cells number about a quarter of the shingles, a power of
    two, so that counts of larger sets can be added up to those of smaller ones. Empty if a count
    does not fit."""
    n_cells = 8
    while n_cells * 4 < len(shingles):
        n_cells *= 2
    cell = (mix(shingles ^ _CELL_SEED) & np.uint64(n_cells - 1)).astype(np.int64)
    counts = np.bincount(cell, minlength=n_cells)
    return b"" if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of the shingles two sets share, from their counts by cell."""
    if not a or not b:
        return min(n_a, n_b)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


@dataclass
class CommonShingles:
    """The shingles that come last in the order, with the binary logarithms of their counts."""

    shingles: np.ndarray
    levels: np.ndarray

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """The levels of some shingles; 0 for those that are not common."""
        if len(self.shingles) == 0:
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.searchsorted(self.shingles, shingles)
        at[at == len(self.shingles)] = 0
        return np.where(self.shingles[at] == shingles, self.levels[at], 0)


def find_common(docs: DataFrame, size: int, most: int) -> CommonShingles:
    """Count, over all documents, the shingles that several classes of one task share."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            shingles = np.concatenate(held)
            held.clear()
            shingles.sort()
            # Every occurrence but the first has an equal one before it.
            again = shingles[1:][shingles[1:] == shingles[:-1]]
            several, more = np.unique(again, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(several.view(np.int64)), pa.array(more.astype(np.int64) + 1)],
                names=["shingle", "n"],
            )

        for batch in batches:
            for own in shingle_sets(batch.column("text"), size):
                name = set_hash(own, _CLASS_SEED)
                if len(own) and name not in seen:
                    seen.add(name)
                    held.append(own)
                    n += len(own)
                    if n >= COUNTED_TOGETHER:
                        yield counted()
                        n = 0
        if held:
            yield counted()
        pa.default_memory_pool().release_unused()

    totals = store(
        docs.select("text")
        .mapInArrow(shared, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n")),
        "shared-shingles",
    )
    # The smallest power of two from which on there are few enough.
    power = F.floor(F.log2("n")).cast("int")
    sizes = {row["p"]: row["k"] for row in totals.groupBy(power.alias("p")).agg(
        F.count(F.lit(1)).alias("k")
    ).collect()}
    least, total = 63, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    kept = totals.select("shingle", power.alias("level")).where(F.col("level") >= least).toArrow()
    shingles = kept.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    levels = kept.column("level").to_numpy().astype(np.uint8)
    return CommonShingles(shingles[order], levels[order])


def sign(docs: DataFrame, common: CommonShingles, size: int, percent: int) -> DataFrame:
    """One row per document: its class, size, a second hash, centrality, window and cells.

    The window (``rare`` and ``shared`` shingles) and the cells are given once per class and task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            columns = {name: [] for name in _SIGNED}
            for own in shingle_sets(batch.column("text"), size):
                n = len(own)
                name = set_hash(own, _CLASS_SEED) if n else None
                first = n > 0 and name not in seen
                rare, frequent, central, cells = None, None, 0, None
                if first:
                    seen.add(name)
                    levels = shared.value.of(own)
                    window = np.lexsort((mix(own), levels))[: n - least_shared(n, percent) + 1]
                    chosen = own[window].view(np.int64)
                    usual = levels[window] > 0
                    rare, frequent = chosen[~usual], chosen[usual]
                    central = int(1_000_000 * levels.mean())
                    cells = cells_of(own)
                for key, value in zip(
                    _SIGNED,
                    (name, n, set_hash(own, _CHECK_SEED), central, rare, frequent, cells),
                    strict=True,
                ):
                    columns[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(columns[k], t) for k, t in _SIGNED.items())],
                names=["doc_id", *_SIGNED],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"doc_id {id_type}, class long, n int, check long, central int, rare array<long>, "
        "shared array<long>, cells binary",
    )


_SIGNED = {
    "class": pa.int64(),
    "n": pa.int32(),
    "check": pa.int64(),
    "central": pa.int32(),
    "rare": pa.list_(pa.int64()),
    "shared": pa.list_(pa.int64()),
    "cells": pa.binary(),
}


def regions_of(signed: DataFrame, slices: int = 1, number: int = 0) -> DataFrame:
    """(region, class, n, place, central) of all regions that can hold two classes, or of those in
    one of several slices.

    ``place`` is how many shingles of the set come before the region's in the common order. Common
    shingles may have regions of any size; those rows are left where they are.
    """
    every = Window.partitionBy("region")
    # Size and place travel as one number: most rows are gone after this shuffle.
    size = F.shiftleft(F.col("n").cast("long"), 32)
    columns = ["region", "class", "size_place", "central"]
    own = F.pmod(F.col("region"), F.lit(slices)) == number
    rare = (
        signed.select("class", "n", "central", F.posexplode("rare").alias("place", "region"))
        .where(own)
        .withColumn("size_place", size + F.col("place"))
        .select(*columns)
        .withColumn("low", F.min("class").over(every))
        .withColumn("high", F.max("class").over(every))
        .where(F.col("low") < F.col("high"))
        .select(*columns)
    )
    frequent = (
        signed.select(
            "class", "n", "central", "rare", F.posexplode("shared").alias("place", "region")
        )
        .where(own)
        .withColumn("size_place", size + F.size("rare") + F.col("place"))
        .select(*columns)
    )
    return (
        rare.unionByName(frequent)
        .dropDuplicates(["region", "class"])
        .select(
            "region",
            "class",
            F.shiftright("size_place", 32).cast("int").alias("n"),
            F.col("size_place").bitwiseAND((1 << 31) - 1).cast("int").alias("place"),
            "central",
        )
    )


def stored_regions(signed: DataFrame) -> DataFrame:
    """The regions of the stored windows, slice by slice: most of what is shuffled for them goes no
    further, so the shuffle files of all at once would be the most disk of the whole job."""
    size = work_size(signed.sparkSession, folder_of(signed))
    slices = min(MOST_SLICES, 1 + size // SLICE_BYTES)
    parts = (regions_of(signed, slices, i) for i in range(slices))
    return store_parts((x.withColumn("group", F.col("class")) for x in parts), "regions")


def pivots_of(regions: DataFrame, parts: int, salt: int) -> DataFrame:
    """The round's pivots: each region is dealt into ``parts`` parts, and the most central class
    of each is a pivot."""
    part = F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(parts))
    return (
        regions.groupBy("region", part.alias("part"))
        .agg(F.max(F.struct("central", "class", "n", "place", "group")).alias("best"))
        .select(
            "region",
            F.col("best.class").alias("a"),
            F.col("best.n").alias("n_a"),
            F.col("best.place").alias("place_a"),
            F.col("best.group").alias("group_a"),
        )
    )


def pivot_pairs(regions: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a pivot a and another class b with the number of regions in which they
    met. Pairs whose sizes and places alone keep them apart, and pairs of one group, are left out.
    """
    others = regions.select(
        "region",
        F.col("class").alias("b"),
        F.col("n").alias("n_b"),
        F.col("place").alias("place_b"),
        F.col("group").alias("group_b"),
    )
    # If this is the first shingle that two sets share, they share at most what is left of either.
    # Of the regions of two linked sets, that of the first shared shingle keeps them.
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return (
        others.join(pivots, "region")
        .where(F.col("group_a") != F.col("group_b"))
        .where(100 * left >= percent * (F.col("n_a") + F.col("n_b") - left))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("met"))
    )


def within_window(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs that the counts by cell leave possible, with the most they can share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(x)).astype(np.int64) for x in ("n_a", "n_b"))
            most = np.fromiter(
                map(
                    most_shared,
                    batch.column("cells_a").to_pylist(),
                    batch.column("cells_b").to_pylist(),
                    n_a.tolist(),
                    n_b.tolist(),
                ),
                dtype=np.int64,
                count=batch.num_rows,
            )
            # J <= most / (n_a + n_b - most)
            possible = pa.array(100 * most >= percent * (n_a + n_b - most))
            kept = batch.append_column("most", pa.array(most)).filter(possible)
            yield kept.select(["a", "b", "n_a", "n_b", "most"])

    of_a = cells.select(F.col("class").alias("a"), F.col("cells").alias("cells_a"))
    of_b = cells.select(F.col("class").alias("b"), F.col("cells").alias("cells_b"))
    return (
        pairs.join(of_a, "a")
        .join(of_b, "b")
        .select("a", "b", "n_a", "n_b", "cells_a", "cells_b")
        .mapInArrow(run, "a long, b long, n_a int, n_b int, most long")
    )


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash of one column, 64 in a word: of one size, however many there are."""
    slot = F.shiftrightunsigned(hashes.columns[0], 64 - FILTER_BITS)
    words = (
        hashes.select(slot.alias("slot"))
        .select(
            F.shiftright("slot", 6).alias("word"),
            F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def _has_bit(table: np.ndarray, name: int) -> bool:
    slot = (name & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
    return bool(int(table[slot >> 6]) >> (slot & 63) & 1)


def _id_hash(doc_id: str = "doc_id") -> Column:
    return F.xxhash64(doc_id)


def sets_of(docs: DataFrame, signed: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(class, shingles) of some classes, from the texts.

    Every class has one id by which its text is found. Bit tables of fixed size, of these ids and of
    the classes, leave nearly all other texts unread and keep other sets from leaving their task.
    """
    context = docs.sparkSession.sparkContext
    found_by = (
        signed.join(classes, "class", "left_semi")
        .groupBy("class")
        .agg(F.min(_id_hash()).alias("id_hash"))
    )
    ids = context.broadcast(_bit_table(found_by.select("id_hash")))
    wanted = context.broadcast(_bit_table(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            slots = batch.column("id_hash").to_numpy().view(np.uint64) >> np.uint64(
                64 - FILTER_BITS
            )
            bits = ids.value[(slots >> np.uint64(6)).astype(np.int64)]
            named = (bits >> (slots & np.uint64(63))) & np.uint64(1)
            names, sets = [], []
            for own in shingle_sets(batch.column("text").filter(pa.array(named == 1)), size):
                if len(own) == 0:
                    continue
                name = set_hash(own, _CLASS_SEED)
                if name not in seen and _has_bit(wanted.value, name):
                    seen.add(name)
                    names.append(name)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sets, pa.binary())],
                names=["class", "shingles"],
            )

    return (
        docs.select(_id_hash().alias("id_hash"), "text")
        .mapInArrow(run, "class long, shingles binary")
        .join(classes, "class", "left_semi")
        .groupBy("class")
        .agg(F.min("shingles").alias("shingles"))
    )


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, links) with the exact answer whether they link.

    The set of ``b`` moves to its pivot ``a``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for x, y in zip(
                batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True
            ):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((a, b)), kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                answers.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(answers, pa.bool_())],
                names=["a", "b", "links"],
            )

    of_a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    of_b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    return (
        pairs.select("a", "b")
        .join(of_b, "b")
        .join(of_a, "a")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(run, "a long, b long, links boolean")
    )


def grouped(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs with the groups of both classes; a class without links is its own group."""
    for side in ("a", "b"):
        named = groups.select(F.col("node").alias(side), F.col("component").alias(f"group_{side}"))
        pairs = pairs.join(named, side, "left").withColumn(
            f"group_{side}", F.coalesce(f"group_{side}", side)
        )
    return pairs


def nearest_pivots(pairs: DataFrame) -> DataFrame:
    """The pair (a, b) of each class b with the pivot that it met in most regions."""
    nearest = F.max(F.struct("met", "a", "n_a", "n_b")).alias("nearest")
    return pairs.groupBy("b").agg(nearest).select("nearest.a", "b", "nearest.n_a", "nearest.n_b")


def nearest_of_groups(pairs: DataFrame) -> DataFrame:
    """Of all pairs between two groups, the one that met in most regions."""
    nearest = F.max(F.struct("met", "a", "b", "n_a", "n_b")).alias("nearest")
    return (
        pairs.groupBy(
            F.least("group_a", "group_b").alias("low"), F.greatest("group_a", "group_b").alias("high")
        )
        .agg(nearest)
        .select("nearest.a", "nearest.b", "nearest.n_a", "nearest.n_b")
    )


def class_groups(
    docs: DataFrame,
    signed: DataFrame,
    cells: DataFrame,
    regions: DataFrame,
    size: int,
    percent: int,
    first_pivots: int,
    all_links: bool = False,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, component), the group of every class that links with another, and the links (a, b)
    of classes that were found; None if no class links.

    With ``all_links`` pairs inside a group are compared too, so the links are all there are, each
    given once with a < b. Without, they are enough of them to hold the groups together.
    The stored ``regions`` are removed as the rounds go on.
    """
    regions = gathered(regions)
    links, groups, sets, known, answered = None, None, None, None, None
    parts, number = first_pivots, 0
    while not regions.isEmpty():
        pivots = gathered(store(pivots_of(regions, parts, number), "pivots"))
        pairs = pivot_pairs(regions, pivots, percent)
        if answered is not None:
            pairs = pairs.join(answered, ["a", "b"], "left_anti")
        waiting = gathered(store(pairs, "waiting"))
        # Each class meets the pivot of its cell first. Then two groups meet by one pair, for as long
        # as that joins groups. What is left are pairs of groups that seem apart: all are compared.
        chosen = waiting if all_links else gathered(store(nearest_pivots(waiting), "chosen"))
        everyone = all_links
        while True:
            possible = gathered(store(within_window(chosen, cells, percent), "possible"))
            found = None
            if not possible.isEmpty():
                classes = (
                    possible.select(F.col("a").alias("class"))
                    .union(possible.select(F.col("b").alias("class")))
                    .dropDuplicates()
                )
                if known is not None:
                    classes = classes.join(known, "class", "left_anti")
                classes = gathered(store(classes, "classes"))
                if not classes.isEmpty():
                    fresh = store(sets_of(docs, signed, classes, size), "sets")
                    sets = fresh if sets is None else sets.unionByName(fresh)
                    known = classes if known is None else known.unionByName(classes)
                answers = gathered(store(linked(possible, sets, percent), "answers"))
                met = answers.select("a", "b")
                met = met.union(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
                answered = met if answered is None else answered.unionByName(met)
                found = answers.where("links").select("a", "b")
                if found.isEmpty():
                    found = None
                else:
                    links = found if links is None else links.unionByName(found)
            if everyone:
                break
            if found is not None:
                groups = regrouped(links, groups)
            left = waiting.select("a", "b", "n_a", "n_b", "met").join(
                chosen, ["a", "b"], "left_anti"
            )
            if groups is not None:
                left = grouped(left, groups).where(F.col("group_a") != F.col("group_b"))
            else:
                left = left.withColumns({"group_a": F.col("a"), "group_b": F.col("b")})
            everyone = found is None or found.count() * LEAST_JOINED < chosen.count()
            before = waiting, chosen, possible
            waiting = gathered(store(left, "waiting"))
            discard(*before)
            if waiting.isEmpty():
                break
            chosen = (
                waiting if everyone else gathered(store(nearest_of_groups(waiting), "chosen"))
            )
        discard(waiting, chosen, possible)
        if everyone and links is not None and not all_links:
            groups = regrouped(links, groups)
        before = regions, pivots
        regions = gathered(store(_remaining(regions, pivots, groups), "regions"))
        discard(*before)
        parts, number = parts * 4, number + 1
    discard(regions)
    if all_links and links is not None:
        ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        links = store(links.select(*ends).dropDuplicates(), "links")
        groups = components(links)
    return groups, links


def regrouped(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The groups by all links found so far, made from earlier ones and in their place."""
    found = components(links, groups)
    discard(groups)
    return found


def _remaining(regions: DataFrame, pivots: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The regions without their pivots, as far as they still hold two groups."""
    gone = pivots.select("region", F.col("a").alias("class"))
    left = regions.drop("group").join(gone, ["region", "class"], "left_anti")
    if groups is None:
        left = left.withColumn("group", F.col("class"))
    else:
        named = groups.select(F.col("node").alias("class"), F.col("component").alias("group"))
        left = left.join(named, "class", "left").withColumn(
            "group", F.coalesce("group", "class")
        )
    open_regions = (
        left.groupBy("region")
        .agg(F.min("group").alias("low"), F.max("group").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("region")
    )
    return left.join(open_regions, "region", "left_semi").select(
        "region", "class", "n", "place", "central", "group"
    )


def signed_groups(
    documents: DataFrame,
    doc_id: str,
    text: str,
    size: int,
    percent: int,
    common: int,
    pivots: int,
    all_links: bool = False,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(doc_id, n, class, check) of each document, and groups and links of the classes that link."""
    ship(documents.sparkSession)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with shuffles_freed(documents.sparkSession):
        common_shingles = find_common(docs, size, common)
        windows = store(sign(docs, common_shingles, size, percent), "windows")
        regions = stored_regions(windows)
        cells = (
            windows.where(F.col("cells").isNotNull())
            .groupBy("class")
            .agg(F.min("cells").alias("cells"))
        )
        cells = store(cells, "cells")
        signed = store(windows.select("doc_id", "n", "class", "check"), "signed")
        # The windows take more disk than all that is left of them.
        discard(windows)
        groups, links = class_groups(
            docs, signed, cells, regions, size, percent, pivots, all_links
        )
        discard(cells)
    return signed, groups, links


def with_groups(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows with ``class``, and the ``group`` of each: the class itself if it links with none."""
    if groups is None:
        return classes.withColumn("group", F.col("class"))
    named = groups.select(F.col("node").alias("class"), F.col("component").alias("group"))
    return classes.join(named, "class", "left").withColumn("group", F.coalesce("group", "class"))


def classes_of(rows: DataFrame) -> DataFrame:
    """(class, least, n_rows): the smallest id and the number of rows of each class.

    Two different sets with one hash would be one class; a second hash tells, and the job fails.
    """
    clash = F.raise_error(F.lit("two sets have the same class hash")).cast("bigint")
    same = F.col("low") == F.col("high")
    return (
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"),
            F.count(F.lit(1)).alias("n_rows"),
            F.min("check").alias("low"),
            F.max("check").alias("high"),
        )
        .select(F.when(same, F.col("class")).otherwise(clash).alias("class"), "least", "n_rows")
    )


def link_components(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    common: int = COMMON,
    first_pivots: int = FIRST_PIVOTS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) of each document.

    Documents with the same ``class`` have equal sets. ``percent`` is the least similarity in
    hundredths, ``size`` the words of a shingle.
    """
    rows, groups, _ = signed_groups(documents, doc_id, text, size, percent, common, first_pivots)
    return _with_components(rows, groups)


def _with_components(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    classes = with_groups(classes_of(rows), groups).select("class", "group", "least")
    if groups is not None:
        # Only classes that link have a group of several.
        of_group = (
            classes.where(F.col("group").isNotNull())
            .groupBy("group")
            .agg(F.min("least").alias("group_least"))
        )
        classes = classes.join(of_group, "group").select(
            "class", F.col("group_least.doc_id").alias("component_id")
        )
    else:
        classes = classes.select("class", F.col("least.doc_id").alias("component_id"))
    return rows.join(classes, "class", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
        "class",
    )


def link_pairs(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    common: int = COMMON,
    first_pivots: int = FIRST_PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """All links: the members (doc_id, n_shingles, component_id, class) of the classes, and the
    pairs (a, b) of different classes that link, each once with a < b.

    Every two documents of one class link, and every document of ``a`` with every one of ``b``.
    """
    rows, groups, links = signed_groups(
        documents, doc_id, text, size, percent, common, first_pivots, all_links=True
    )
    if links is None:
        links = documents.sparkSession.createDataFrame([], "a long, b long")
    return _with_components(rows, groups), links


def link_counts(documents: DataFrame, *args, **settings) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of each document.

    ``n_links`` counts the other rows that a row links with, copies of its own text among them.
    """
    members, links = link_pairs(documents, *args, **settings)
    sizes = (
        members.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (
        both.join(sizes.withColumnRenamed("class", "b"), "b")
        .groupBy(F.col("a").alias("class"))
        .agg(F.sum("n_rows").alias("n_others"))
    )
    of_class = sizes.join(others, "class", "left").select(
        "class", (F.col("n_rows") - 1 + F.coalesce("n_others", F.lit(0))).alias("n_links")
    )
    return members.join(of_class, "class", "left").select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("class").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_one(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    common: int = COMMON,
    first_pivots: int = FIRST_PIVOTS,
) -> DataFrame:
    """One document of each group, with all columns: the smallest id, and of equal ids the first
    text. Documents with an empty set all stay.

    A text whose class has one row and no link stays where it is; only the others, told by a bit
    table of fixed size, move to be joined with the decision.
    """
    rows, groups, _ = signed_groups(documents, doc_id, text, size, percent, common, first_pivots)
    classes = store(with_groups(classes_of(rows), groups), "classes")
    linking = classes.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("n_rows").alias("n_rows")
    ).where(F.col("n_rows") > 1)
    contested = store(
        classes.join(linking.select("group"), "group", "left_semi"), "contested"
    )
    chosen = (
        contested.groupBy("group")
        .agg(F.min(F.struct("least", "class")).alias("first"))
        .select(
            F.col("first.least.doc_id").alias("keep_id"), F.col("first.class").alias("keep")
        )
    )
    bits = documents.sparkSession.sparkContext.broadcast(_bit_table(contested.select("class")))

    @F.pandas_udf("class long, contested boolean")
    def named(texts: pd.Series) -> pd.DataFrame:
        names, asked = [], []
        for own in shingle_sets(pa.array(texts, pa.large_string()), size):
            name = set_hash(own, _CLASS_SEED) if len(own) else None
            names.append(name)
            asked.append(name is not None and _has_bit(bits.value, name))
        pa.default_memory_pool().release_unused()
        return pd.DataFrame({"class": pd.array(names, dtype="Int64"), "contested": asked})

    # The row travels as one struct, so that no column of it can meet a name used here.
    columns = [F.col(f"`{c}`") for c in documents.columns]
    marked = documents.select(F.struct(*columns).alias("row")).withColumn(
        "named", named(F.col("row").getField(text))
    )
    alone = marked.where(~F.col("named.contested")).select("row.*")
    moved = marked.where(F.col("named.contested"))
    # A bit may stand for other classes too: what is not contested after all stays as well.
    known = contested.select(F.col("class").alias("known"))
    decided = (
        moved.join(known, F.col("named.class") == F.col("known"), "left")
        .join(
            chosen,
            (F.col("named.class") == F.col("keep"))
            & F.col("row").getField(doc_id).eqNullSafe(F.col("keep_id")),
            "left",
        )
        .where(F.col("known").isNull() | F.col("keep").isNotNull())
    )
    first = Window.partitionBy("named.class").orderBy(F.col("row").getField(text), F.to_json("row"))
    single = (
        decided.withColumn("rank", F.row_number().over(first))
        .where(F.col("keep").isNull() | (F.col("rank") == 1))
        .select("row.*")
    )
    return alone.unionByName(single)
