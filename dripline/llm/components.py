"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dripline.llm.support import discard, folder_of, gathered, store, stored_at


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node in links (a, b); a component's name is its smallest node.

    Every node takes the smallest name among its neighbours, then the name that this name has by
    now, until nothing changes: names travel twice as far each round. Smallest names are found by
    aggregation, which a node with very many neighbours leaves as one row per task. Each round
    is written to the shared folder, so a lost executor costs no earlier round; the one before is
    removed then. The tables of small graphs are read by one task and not shuffled. ``known`` are
    the components by some of the links; from them fewer rounds are left.
    """
    both = gathered(
        store(
            links.select("a", "b")
            .union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .dropDuplicates(),
            "neighbours",
        )
    )
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    smallest = ["node", "least"]
    if known is not None:
        first = first.join(known.select("node", F.col("component").alias("known")), "node", "left")
        smallest.append("known")
    names = gathered(store(first.select("node", F.least(*smallest).alias("component")), "names"))
    while True:
        heard = (
            both.join(names.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        nearer = names.join(heard, "node").select(
            "node", "component", F.least("component", "heard").alias("found")
        )
        further = names.select(
            F.col("node").alias("found"), F.col("component").alias("beyond")
        )
        moved = gathered(
            store(
                nearer.join(further, "found").select(
                    "node",
                    F.least("found", "beyond").alias("component"),
                    (F.least("found", "beyond") != F.col("component")).alias("changed"),
                ),
                "names",
            )
        )
        discard(names)
        names = stored_at(moved.select("node", "component"), folder_of(moved))
        if moved.where("changed").isEmpty():
            discard(both)
            return names
