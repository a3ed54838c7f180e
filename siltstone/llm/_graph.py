"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.llm._io import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (columns a, b); root is the smallest node reachable.

    Each round maps every node to its smallest neighbour and keeps the edges between the images, so
    a star or a clique goes in one round and a path at least halves. All steps are aggregations with
    map-side partial results, or joins that adaptive execution may split; each round ends in a
    written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    live = materialize(both.distinct(), "edges")
    maps, old = [], []
    while not live.isEmpty():
        step = materialize(live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "step")
        moved = live.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(step, "a").select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct()
        after = materialize(moved, "edges")
        discard(live)
        maps.append(step)
        live = after
    old.append(live)
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in maps[1:]:
        out = out.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(out, "roots")
