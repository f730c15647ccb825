"""Order, limit, distinct-on and top-k.

Nulls sort as the largest value: last in ascending and first in descending
order, unless a key says otherwise.  A key is a Column or a name, descending
with a leading ``-``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.tables import cut


def key(k: str | Column) -> Column:
    if isinstance(k, Column):
        return k
    return F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last()


def keys(*ks: str | Column) -> list[Column]:
    return [key(k) for k in ks]


def order_by(df: DataFrame, *ks: str | Column) -> DataFrame:
    return df.orderBy(*keys(*ks))


def limit_offset(df: DataFrame, order: list[str | Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``; None is no limit."""
    found = order_by(df, *order).offset(offset)
    return found if limit is None else found.limit(limit)


def top_k(df: DataFrame, by: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.  Spark keeps ``k`` rows a group in
    each task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*keys(*order))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def distinct_on(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group."""
    return top_k(df, by, order, 1)


def numbered(df: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all rows:
    ranges are sorted in parallel and numbered behind the counts of those before.
    The ranges are written once, so that both uses see the same ones."""
    ranged = cut(order_by(df, *order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    per = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("_part", "_first", before.alias("_before"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_part", "_id", "_first", "_before")


def running_sum(df: DataFrame, order: list[str | Column], value: str, running: str, total: str) -> DataFrame:
    """SUM(value) OVER (ORDER BY ...), peers included, and OVER (), without one
    task for all rows: ranges are summed in parallel behind the sums of those
    before.  The ranges are written once, so that both uses see the same ones."""
    ranged = cut(order_by(df, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("_part", before.alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias(total))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*keys(*order)))
    found = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_part")
    return found.withColumn(running, F.coalesce(F.col("_before") + F.col("_inside"), "_before", "_inside")).select(*df.columns, running, total)
