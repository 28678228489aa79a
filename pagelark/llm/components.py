"""Connected components of an undirected graph, by contraction.

In each round every node points to its smallest neighbour or itself, pointers are followed to their ends, and the graph
is contracted to those roots. A node that isn't smaller than all its neighbours merges, so at least half of the nodes
with edges go in every round and the number of rounds is logarithmic. Roots are smaller than what points to them, so the
last root of a component is its smallest node. All steps are joins and map-side combined aggregations; their outcomes
are written to the shared folder, and deleted there once the next ones are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace


def connected(edges: DataFrame, scratch: Workspace) -> DataFrame:
    """node and component (its smallest node) of every node in edges, which has the columns a and b."""
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    graph = scratch.keep(both.distinct(), "graph")
    labels = None
    while not graph.isEmpty():
        roots = scratch.keep(graph.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "pointers")
        while True:
            up = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            further = roots.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            further = scratch.keep(further, "pointers")
            scratch.drop(roots)
            roots = further
            if roots.where("moved").isEmpty():
                break
        if labels is None:
            labels = scratch.keep(roots.select(F.col("a").alias("node"), F.col("p").alias("component")), "labels")
        else:
            up = roots.select(F.col("a").alias("component"), "p")
            merged = labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            merged = scratch.keep(merged, "labels")
            scratch.drop(labels)
            labels = merged
        here, there = roots.select("a", "p"), roots.select(F.col("a").alias("b"), F.col("p").alias("q"))
        contracted = graph.join(here, "a").join(there, "b").where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
        contracted = scratch.keep(contracted, "graph")
        scratch.drop(graph, roots)
        graph = contracted
    if labels is None:
        labels = graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
