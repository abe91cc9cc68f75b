"""A Merkle manifest of a table: a tree of digests by language, the trees under one root.

A row's leaf is the digest of its fields. The leaves of a language, in the order of their ids, are
hashed in runs of ``ARITY`` until one node is left, its subroot; the subroots, in the order of the
languages, likewise give the root. A row's proof is the digests beside its way to the root.

1. Leaves are digests, computed where the rows are; texts do not move. The leaves are dealt by
   range and written once. A leaf's place in its language is its place in the range plus the
   numbers of leaves of that language in earlier ranges: no language is ever sorted in one task.
2. Superblocks. ``ARITY ** LEVELS`` consecutive nodes are reduced to one node by one call; its
   output is the input of the next round, until each language has one node. A language with a third
   of all rows is as many superblocks as it needs, and no call sees more than one.
3. Outer nodes. From the root down, every superblock is cogrouped with the digests beside its own
   way up, and gives each of its nodes the digests beside theirs.
4. Exchange. In the last step the leaves of a superblock and its outer nodes meet in one cogroup,
   which finishes the local reduction, joins the proofs and folds the leaves that are presented.

``presented`` names fields whose content is now another than when the manifest was made; the leaf
of that content, folded with the digests beside the original's way, tells whether it was changed.

Defined results: a null field is ``-``. Leaves without an id come first; equal ids are in the order
of their leaves, and where those are equal too, the rows are the same in all but their place. A
null language is a language of its own, before all others. Repeated rows are leaves each. A null
id is not less of a row. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from dripline.llm.support import ship, store

ARITY = 8
LEVELS = 3
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree long, place long, size long, digest string"
_PATH = "tree long, place long, left array<string>, right array<string>, subroot string"


def field_text(value: Column) -> Column:
    """A field as it is hashed: its length in bytes and its text, or a dash."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field_text(x) for x in values)).cast("binary"), 256)


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def reduce_runs(digests: list[str], size: int, levels: int) -> tuple[str, list[list[str]]]:
    """The node above consecutive digests, and the joined digests of the runs of each level.

    ``size`` is how many nodes the whole tree has on this level: a tree within one superblock ends
    at its one node, a superblock of a larger one after ``levels``.
    """
    within = size <= ARITY**levels
    runs = []
    while len(digests) > 1 if within else len(runs) < levels:
        runs.append(
            ["".join(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        )
        digests = [digest(x) for x in runs[-1]]
    return digests[0], runs


def beside(runs: list[list[str]], place: int) -> list[tuple[str, str]]:
    """The joined digests left and right of a node's way through its superblock."""
    out = []
    for level in runs:
        run, at = level[place // ARITY], DIGEST * (place % ARITY)
        out.append((run[:at], run[at + DIGEST :]))
        place //= ARITY
    return out


def ranked_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, place, size, ...) of each leaf, and (tree, size) of each language.

    Range partitions are numbered in order, so counts by partition place every leaf. The tables of
    counts have a row for each partition and each language.
    """
    order = ("lang_key", F.col("doc_id").asc_nulls_first(), "leaf", "row")
    dealt = store(
        leaves.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id()),
        "leaves",
    )
    spans = store(
        dealt.groupBy("lang_key", "part").agg(
            F.min("row").alias("first"), F.count(F.lit(1)).alias("n")
        ),
        "spans",
    )
    earlier = Window.partitionBy("lang_key").orderBy("part")
    in_part = Window.partitionBy("part").orderBy("lang_key")
    languages = spans.groupBy("lang_key").agg(F.min("part").alias("part"), F.sum("n").alias("size"))
    of_part = languages.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    # One row for each range partition.
    before = of_part.select(
        "part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before")
    )
    trees = store(
        languages.withColumn("rank", F.row_number().over(in_part) - 1)
        .join(before, "part")
        .select("lang_key", (F.col("before") + F.col("rank")).alias("tree"), "size"),
        "trees",
    )
    placed = (
        spans.withColumn("offset", F.sum("n").over(earlier) - F.col("n") - F.col("first"))
        .join(trees, "lang_key")
        .select("lang_key", "part", "offset", "tree", "size")
    )
    ranked = dealt.join(placed, ["lang_key", "part"]).withColumn(
        "place", F.col("row") + F.col("offset")
    )
    return ranked.drop("lang_key", "part", "row", "offset"), trees.select("tree", "size")


def superblock(levels: int) -> Column:
    return F.floor(F.col("place") / F.lit(ARITY**levels)).alias("block")


def raised(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes above the superblocks, ``levels`` further up."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        size = int(group["size"].iloc[0])
        above, _ = reduce_runs(group["digest"].tolist(), size, levels)
        width = ARITY**levels
        return pd.DataFrame(
            {"tree": [key[0]], "place": [key[1]], "size": [-(-size // width)], "digest": [above]}
        )

    grouped = nodes.select("tree", "place", "size", "digest", superblock(levels))
    return grouped.groupBy("tree", "block").applyInPandas(run, _NODE)


def tower(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The nodes of each round, from the given ones to one for each tree; all but the first are
    stored."""
    rounds = [nodes]
    while largest > 1:
        rounds.append(store(raised(rounds[-1], levels), "nodes"))
        largest = -(-largest // ARITY**levels)
    return rounds


def descended(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The digests beside the way of each node, from those of the superblocks above."""

    def run(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        _, runs = reduce_runs(group["digest"].tolist(), int(group["size"].iloc[0]), levels)
        ways = [beside(runs, i) for i in range(len(group))]
        left, right = list(above["left"].iloc[0]), list(above["right"].iloc[0])
        return pd.DataFrame(
            {
                "tree": group["tree"].to_numpy(),
                "place": group["place"].to_numpy(),
                "left": [[x for x, _ in way] + left for way in ways],
                "right": [[x for _, x in way] + right for way in ways],
                "subroot": above["subroot"].iloc[0],
            }
        )

    return (
        nodes.select("tree", "place", "size", "digest", superblock(levels))
        .groupBy("tree", "block")
        .cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block"))
        .applyInPandas(run, _PATH)
    )


def manifest(
    documents: DataFrame,
    doc_id: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    presented: dict[str, Column] | None = None,
    levels: int = LEVELS,
    proofs: bool = False,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``presented`` gives, by field, what is there now instead of the content at the time of the
    manifest; ``folded_root`` is the root that the row's present content leads to, and ``verified``
    whether it is the manifest's. With ``proofs`` a column ``proof`` holds the digests beside the
    way themselves, level by level, left to right.
    """
    spark = documents.sparkSession
    ship(spark)
    names = {name: F.col(f"`{name}`") for name in fields}
    # What is presented counts as null rather than as the original where it is null.
    now = {**names, **(presented or {})}
    original, present = leaf_digest(list(names.values())), leaf_digest([now[x] for x in fields])
    leaves = documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        # Null first, then by bytes.
        F.coalesce(
            F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")
        ).alias("lang_key"),
        original.alias("leaf"),
        (present if presented else F.lit(None).cast("string")).alias("present"),
    ).withColumn("present", F.nullif("present", F.col("leaf")))
    ranked, trees = ranked_leaves(leaves)
    ranked = store(ranked, "ranked")
    id_type = ranked.schema["doc_id"].dataType.simpleString()
    output = (
        f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean" + (", proof array<string>" if proofs else "")
    )
    extent = trees.agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("n")).first()
    if not extent["n"]:
        return spark.createDataFrame([], output)

    lower = tower(ranked.withColumnRenamed("leaf", "digest"), extent["largest"], levels)
    subroots = lower[-1].select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("place"),
        F.lit(extent["n"]).cast("long").alias("size"),
        "digest",
    )
    upper = tower(subroots, extent["n"], levels)
    root = upper[-1].first()["digest"]

    none = F.array().cast("array<string>")
    outer = upper[-1].select(
        "tree", "place", none.alias("left"), none.alias("right"), F.col("digest").alias("subroot")
    )
    for nodes in reversed(upper[:-1]):
        outer = descended(nodes, outer, levels)
    outer = outer.drop("subroot").withColumnRenamed("tree", "top").join(
        subroots.select("place", F.col("digest").alias("subroot")), "place"
    )
    outer = store(
        outer.select(
            F.col("place").alias("tree"),
            F.lit(0).cast("long").alias("place"),
            "left",
            "right",
            "subroot",
        ),
        "outer",
    )
    for nodes in reversed(lower[1:-1]):
        outer = store(descended(nodes, outer, levels), "outer")

    def finish(key: tuple, leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("place")
        digests, size = leaves["leaf"].tolist(), int(leaves["size"].iloc[0])
        _, runs = reduce_runs(digests, size, levels)
        outer_way = list(zip(above["left"].iloc[0], above["right"].iloc[0], strict=True))
        outer_proof = "".join(left + right for left, right in outer_way)
        reached: dict[str, str] = {}
        proved, folded, ways = [], [], []
        for i, (leaf, present) in enumerate(zip(digests, leaves["present"], strict=True)):
            way = beside(runs, i)
            proof = "".join(left + right for left, right in way) + outer_proof
            proved.append(digest(proof))
            at = present or leaf
            for left, right in way:
                at = digest(left + at + right)
            if at not in reached:
                # Siblings stand beside the way, so what leads on is one digest at each level.
                up = at
                for left, right in outer_way:
                    up = digest(left + up + right)
                reached[at] = up
            folded.append(reached[at])
            if proofs:
                ways.append([proof[j : j + DIGEST] for j in range(0, len(proof), DIGEST)])
        out = pd.DataFrame(
            {
                "doc_id": leaves["doc_id"].to_numpy(),
                "leaf": digests,
                "subroot": above["subroot"].iloc[0],
                "root": root,
                "proof_sha256": proved,
                "folded_root": folded,
                "verified": [x == root for x in folded],
            }
        )
        if proofs:
            out["proof"] = ways
        return out

    # Ids travel as text: pandas would turn whole numbers beside a null into floating point.
    text_id = F.col("doc_id").cast("string").alias("doc_id")
    found = (
        ranked.select(text_id, "tree", "place", "size", "leaf", "present", superblock(levels))
        .groupBy("tree", "block")
        .cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block"))
        .applyInPandas(finish, output.replace(id_type, "string", 1))
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))
