"""Recursive queries: fixpoint union, tree walk, cross tabulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.sources.tables import cut


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE seed UNION [ALL] step(previous round).

    With ``distinct`` rows seen before are dropped, so cycles end.  Each round
    is written to the shared folder, which keeps plans short and survives lost
    executors.
    """
    fresh = cut(seed.distinct() if distinct else seed, "round")
    parts = [fresh]
    for _ in range(rounds):
        found = step(fresh).select(*seed.columns)
        if distinct:
            # null-safe: unlike a join on equality, rows with nulls count as seen
            marked = [F.col(c).eqNullSafe(F.col(f"_seen_{c}")) for c in seed.columns]
            seen = parts[0]
            for p in parts[1:]:
                seen = seen.unionByName(p)
            on = marked[0]
            for m in marked[1:]:
                on = on & m
            found = found.distinct().join(seen.toDF(*(f"_seen_{c}" for c in seed.columns)), on, "left_anti")
        fresh = cut(found, "round")
        if fresh.isEmpty():
            break
        parts.append(fresh)
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def connect_by(rows: DataFrame, key: str, parent: str, start: object, depth: int = 0, delimiter: str = "~") -> DataFrame:
    """The tree below ``start``: key, parent, level and the branch to each row.
    ``depth`` 0 is no bound; a row that is its own ancestor is an error."""
    edges = rows.select(F.col(key).alias("_k"), F.col(parent).alias("_p")).filter(F.col("_p").isNotNull())
    kind = dict(rows.dtypes)[key]
    seed = rows.sparkSession.range(1).select(F.lit(start).cast(kind).alias(key), F.lit(None).cast(kind).alias(parent), F.lit(0).alias("level"), F.lit(str(start)).alias("branch"))

    def step(last: DataFrame) -> DataFrame:
        near = last if depth == 0 else last.filter(F.col("level") < depth)
        met = near.join(edges, F.col(key) == F.col("_p"))
        loop = F.array_contains(F.split("branch", F.lit("\\Q" + delimiter + "\\E")), F.col("_k").cast("string"))
        checked = F.when(loop, F.raise_error(F.lit("infinite recursion detected"))).otherwise(F.concat_ws(delimiter, "branch", F.col("_k").cast("string")))
        return met.select(F.col("_k").alias(key), F.col("_p").alias(parent), (F.col("level") + 1).alias("level"), checked.alias("branch"))

    return recursive_union(seed, step, distinct=False)


def paths(edges: DataFrame, start: DataFrame, depth: int = 0) -> DataFrame:
    """All paths along edges (parent, child) from the nodes of ``start``: node,
    path and ``cycle``, true where the last node stands in the path before; a path
    ends there."""
    seed = start.select("node", F.array("node").alias("path"), F.lit(False).alias("cycle"))

    def step(last: DataFrame) -> DataFrame:
        going = last.filter(~F.col("cycle") & ((F.size("path") <= depth) if depth else F.lit(True)))
        met = going.join(edges, F.col("node") == F.col("parent"))
        return met.select(F.col("child").alias("node"), F.array_append("path", F.col("child")).alias("path"), F.array_contains("path", F.col("child")).alias("cycle"))

    return recursive_union(seed, step, distinct=False)


def crosstab(df: DataFrame, row: str, category: str, value: Column, categories: list[str]) -> DataFrame:
    """One column a category; categories without a row are null."""
    return df.groupBy(row).pivot(category, categories).agg(value)
