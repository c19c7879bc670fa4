"""Connected components by repeated hooking and contraction, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import join_counted, materialize, remove, scratch


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b).

    In a round every node hooks to its smallest neighbour and edges are drawn anew
    between hooks; nodes are expected to be hashes, so that a round leaves a fixed part
    of them. A node of very many edges is joined by broadcast (see ``join_counted``). Only
    counts reach the driver; each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").filter("a <> b").distinct()
    rounds: list[DataFrame] = []
    last = None
    while True:
        path = scratch(spark, "edges")
        edges = materialize(edges, path)
        if last:
            remove(spark, last)
        last = path
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).select("a", F.least("a", "b").alias("hook"), "n")
        hooks = materialize(hooks, scratch(spark, "hooks"))
        rounds.append(hooks)
        count = edges.count()
        moved = join_counted(edges, hooks.withColumnRenamed("hook", "x"), "a", "n", 2 * count).select("b", "x")
        moved = join_counted(moved, hooks.select(F.col("a").alias("b"), F.col("hook").alias("y"), "n"), "b", "n", 2 * count)
        edges = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select(F.col("a").alias("node"), F.col("hook").alias("component"))
    for hooks in rounds[1:]:
        # hooks counts edges, not rows of ``found``; a component of very many nodes is counted anew
        n = found.groupBy("component").agg(F.count("*").alias("n"))
        next_ = n.join(hooks.select(F.col("a").alias("component"), "hook"), "component")
        found = join_counted(found, next_, "component", "n", found.count(), "left").select("node", F.coalesce("hook", "component").alias("component"))
        found = materialize(found, scratch(spark, "components"))
    return found if len(rounds) > 1 else materialize(found, scratch(spark, "components"))
