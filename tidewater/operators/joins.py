"""Joins with merged key columns, null-aware NOT IN and row comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def using(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: one column for each key, the left or else the right value."""
    return left.join(right, on, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """JOIN on all columns of the same name; without any, every pair of rows."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def not_in(left: DataFrame, column: str, right: DataFrame, value: str) -> DataFrame:
    """``column NOT IN (SELECT value ...)`` with SQL's nulls: no row passes when
    the right side holds a null, no null passes unless the right side is empty.

    Spark's own null-aware anti join must broadcast the right side; here the
    nulls are one row of counts and the rest is an ordinary shuffled anti join.
    """
    counts = right.agg(F.count("*").alias("_n"), F.count(F.col(value)).alias("_known"))
    rest = left.join(right.select(F.col(value).alias("_v")), F.col(column) == F.col("_v"), "left_anti")
    passes = (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(column).isNotNull())
    return rest.join(F.broadcast(counts)).filter(passes).select(*left.columns)  # counts is one row


def scalar(df: DataFrame, value: DataFrame) -> DataFrame:
    """``df`` with the columns of a frame of one row: an uncorrelated scalar
    subquery.  Without a row they are null; two rows are an error."""
    names = value.columns
    one = value.agg(F.count("*").alias("_rows"), *(F.first(c).alias(c) for c in names))
    one = one.select(F.when(F.col("_rows") > 1, F.raise_error(F.lit("more than one row returned by a subquery"))).cast("int").alias("_checked"), *names)
    return df.join(F.broadcast(one)).filter(F.col("_checked").isNull()).drop("_checked")


def row(*columns: str) -> Column:
    """A row value; compares field by field."""
    return F.struct(*(F.col(c).alias(f"f{i}") for i, c in enumerate(columns)))


def compare_any(left: DataFrame, column: str, sign: str, right: DataFrame, value: str, name: str) -> DataFrame:
    """``left`` with ``name``: whether ``column sign ANY (SELECT value ...)``, null
    if only nulls keep it from being false.  The right side becomes one row."""
    return _compared(left, column, sign, right, value, name, True)


def compare_all(left: DataFrame, column: str, sign: str, right: DataFrame, value: str, name: str) -> DataFrame:
    """Whether ``column sign ALL (SELECT value ...)``; true for no rows."""
    return _compared(left, column, sign, right, value, name, False)


def _compared(left: DataFrame, column: str, sign: str, right: DataFrame, value: str, name: str, some: bool) -> DataFrame:
    x, low, high = F.col(column), F.col("_low"), F.col("_high")
    if (sign, some) in (("=", True), ("<>", False)):
        found = right.filter(F.col(value).isNotNull()).select(F.col(value).alias(column)).distinct().withColumn("_in", F.lit(True))
        left = left.join(found, column, "left")
        told = F.coalesce("_in", F.lit(False)) if some else F.col("_in").isNull()
    else:
        least, most = (low, high) if some else (high, low)
        told = {"<": x < most, "<=": x <= most, ">": x > least, ">=": x >= least, "=": (x == low) & (x == high), "<>": (x != low) | (x != high)}[sign]
    one = right.agg(F.count("*").alias("_n"), F.count(F.col(value)).alias("_known"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    settled = F.when(F.col("_n") == 0, F.lit(not some)).when(x.isNull(), F.lit(None).cast("boolean"))
    settled = settled.when((F.col("_known") > 0) & (told if some else ~told), F.lit(some)).when(F.col("_n") > F.col("_known"), F.lit(None).cast("boolean")).otherwise(F.lit(not some))
    return left.join(F.broadcast(one)).withColumn(name, settled).drop("_n", "_known", "_low", "_high", "_in")  # one row


def array_of(df: DataFrame, rows: DataFrame, on: list[str], value: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with ARRAY(SELECT value ... ORDER BY order) for its key; empty
    without rows."""
    lists = rows.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*order, value.alias("_value")))).alias("_list"))
    kind = rows.select(value.alias("v")).schema["v"].dataType.simpleString()
    got = F.transform("_list", lambda z: z["_value"])
    return df.join(lists, on, "left").withColumn(name, F.coalesce(got, F.array().cast(f"array<{kind}>"))).drop("_list")


def unique_inner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` for the distinct keys of ``right``: the join with a
    right side made unique first."""
    return left.join(right.select(*on).distinct(), on)
