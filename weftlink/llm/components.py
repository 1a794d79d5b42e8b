"""Connected components of a distributed graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, looked_up, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that edges (a, b) touch; root is one of the component's nodes.

    Union-find in rounds: each node hooks onto its smallest smaller neighbour,
    pointers are doubled, and edges are rewritten to the roots, until none is
    left.  Tables shrink from round to round and are written in between; the
    driver sees only whether edges are left.  A root that many nodes hook onto is
    looked up by broadcast, so no task holds all its nodes.  Ids that are hashes
    keep chains short.  Loops, repeated edges and nulls do no harm.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    roots = None
    while not links.isEmpty():
        hook = materialise(links.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "node"), "hook")
        for _ in range(2):
            onward = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
            further = materialise(looked_up(hook, onward, "to").select("node", F.coalesce("further", "to").alias("to")), "hook")
            forget(hook)
            hook = further
        own = hook.select("node", F.col("to").alias("root"))
        if roots is None:
            now = own.unionByName(links.select(F.col("b").alias("node")).distinct().join(own, "node", "left_anti").withColumn("root", F.col("node")))
        else:
            step = own.withColumnRenamed("root", "to").withColumnRenamed("node", "root")
            now = looked_up(roots, step, "root").select("node", F.coalesce("to", "root").alias("root"))
        now = materialise(now, "roots")
        half = materialise(looked_up(links, own.toDF("a", "ra"), "a"), "half")
        moved = looked_up(half, own.toDF("b", "rb"), "b").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        left = materialise(moved.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        for done in (links, hook, half):
            forget(done)
        if roots is not None:
            forget(roots)
        links, roots = left, now
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
