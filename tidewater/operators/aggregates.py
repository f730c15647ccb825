"""Aggregates that differ from Spark's own in nulls, order or exactness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows or states at most meet in one array of a merged aggregate's first steps.
CHUNK = 4096


def array_agg(value: Column, *order: Column) -> Column:
    """All values of a group, nulls too, in ``order``; null without rows."""
    pairs = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))
    found = F.transform(F.array_sort(pairs) if order else pairs, lambda p: p["v"])
    return F.when(F.size(found) > 0, found)


def exact_avg(value: Column) -> Column:
    """The mean of integers as a decimal."""
    return F.avg(value.cast("decimal(20,6)"))


def interval_sum(span: Column) -> Column:
    """The sum of day-time intervals as (days, seconds), neither carried into the
    other.  Spark's own sum is one interval, which ends at 106,751,991 days."""
    part = lambda unit: F.extract(F.lit(unit), span)
    seconds = part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
    return F.struct(F.sum(part("DAY").cast("long")).alias("days"), F.sum(seconds).alias("seconds"))


def xmlagg(value: Column, *order: Column) -> Column:
    kept = F.filter(F.coalesce(array_agg(value, *order), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, ""))


def user_aggregate(value: Column, zero: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None, *order: Column) -> Column:
    """CREATE AGGREGATE: a transition over the values of a group, then a final
    function.  For a transition that Spark's aggregates can't express and that
    has no merge function or needs ``order``; each group's values meet in one
    row, so groups must be small.  See ``merged_aggregate`` for others."""
    found = F.coalesce(array_agg(value, *order), F.array().cast("array<double>"))
    return F.aggregate(found, zero, step, final) if final else F.aggregate(found, zero, step)


def merged_aggregate(
    df: DataFrame,
    by: list[str],
    value: Column,
    name: str,
    zero: Column,
    step: Callable[[Column, Column], Column],
    merge: Callable[[Column, Column], Column],
    final: Callable[[Column], Column] = lambda a: a,
) -> DataFrame:
    """CREATE AGGREGATE with a combine function, for groups of any size: the
    transition runs over chunks of a group's rows, and states are merged twice.
    ``zero`` must be neutral to ``merge``."""
    rows = df.select(*by, value.alias("_v"), F.floor(F.monotonically_increasing_id() / CHUNK).alias("_chunk"))
    states = rows.groupBy(*by, "_chunk").agg(F.aggregate(F.collect_list(F.struct("_v")), zero, lambda a, x: step(a, x["_v"])).alias("_s"))
    states = states.groupBy(*by, F.pmod(F.xxhash64("_chunk"), F.lit(CHUNK)).alias("_salt")).agg(F.aggregate(F.collect_list(F.struct("_s")), zero, lambda a, x: merge(a, x["_s"])).alias("_s"))
    return states.groupBy(*by).agg(F.aggregate(F.collect_list(F.struct("_s")), zero, lambda a, x: merge(a, x["_s"]), final).alias(name))


def normal_rand(spark: SparkSession, n: int, mean: float, deviation: float, seed: int | None = None) -> DataFrame:
    """``n`` normally distributed values."""
    return spark.range(n).select((F.randn(seed) * deviation + mean).alias("value"))
