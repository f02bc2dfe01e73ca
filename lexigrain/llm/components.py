"""Connected components by contraction, as rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrain.storage import StoredTable

#: Pointer steps taken in a round before the graph is contracted.
JUMPS = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (``a``, ``b``, both long).

    Each round points every node to its smallest neighbour, follows the pointers a few steps, and replaces
    edges by those between the nodes pointed to. A star is gone in one round and a path shrinks by a factor
    per round. A hub's edges are combined before the shuffle; what a round leaves is written and re-read,
    so lineage stays short and a lost executor costs a re-read.
    """
    graph = StoredTable(_both_ways(edges.select("a", "b")), "edges")
    labels = None
    while graph.df.limit(1).count():
        least = graph.df.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        for _ in range(JUMPS):
            step = least.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            least = least.join(step, least["to"] == step["n2"], "left").select("node", F.coalesce("t2", "to").alias("to"))
        pointer = StoredTable(least, "pointers")
        if labels is None:
            fresh = pointer.df
        else:
            last = pointer.df.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            fresh = labels.df.join(last, labels.df["to"] == last["n2"], "left").select("node", F.coalesce("t2", "to").alias("to"))
        old_labels, labels = labels, StoredTable(fresh, "labels")
        first, second = (pointer.df.select(F.col("node").alias(f"n{s}"), F.col("to").alias(s)) for s in "xy")
        moved = (
            graph.df.join(first, graph.df["a"] == first["nx"])
            .join(second, graph.df["b"] == second["ny"])
            .where("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        old_graph, graph = graph, StoredTable(moved, "edges")
        for table in (old_graph, old_labels, pointer):
            if table is not None:
                table.drop()
    if labels is None:
        return graph.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.df.select("node", F.col("to").alias("component"))


def _both_ways(edges: DataFrame) -> DataFrame:
    rows = edges.where("a <> b")
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
