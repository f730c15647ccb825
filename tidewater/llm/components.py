"""Connected components of an edge table, by contraction.

Each round lets every node hang on its smallest neighbour, follows those
pointers to their ends by doubling, and goes on with the edges between ends.
The number of rounds grows with the logarithm of the number of nodes; all
tables stay in Spark, written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(parents: DataFrame) -> DataFrame:
    """node, root from node, parent (parent < node; roots have no row)."""
    current = parents.select("node", F.col("parent").alias("root"))
    while True:
        up = current.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = current.join(up, "root", "left")
        moved = materialize(step.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        current = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return current


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges
    (a, b); nodes without edges are not listed."""
    left = materialize(edges.select("a", "b").filter("a <> b"), "edges")
    found = None
    while not left.isEmpty():
        parents = _both(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).filter("parent < node")
        roots = _roots(materialize(parents, "parents"))
        here = left
        for side in ("a", "b"):
            ends = roots.select(F.col("node").alias(side), F.col("root").alias("root"))
            other = "b" if side == "a" else "a"
            here = here.join(ends, side, "left").select(F.coalesce("root", side).alias(side), other)
        # the smaller ends of edges between roots are no node of ``roots`` yet
        left = materialize(here.filter("a <> b").distinct(), "edges")
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            moved = found.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            found = materialize(moved.union(roots.join(found, "node", "left_anti")), "found")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = found.select(F.col("root").alias("node"), "root").distinct()
    return found.union(ends.join(found, "node", "left_anti")).select("node", F.col("root").alias("component"))
