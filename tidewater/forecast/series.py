"""Time series: columns of keys, ``t`` (time), ``y`` (measure), ``x`` (1..n).

Rows of a key are numbered in the order of time.  A frame without keys is one
series; it has one row a period, so its window holds few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.dates import add_months_stepwise

#: Steps in months or days; an hour is the only finer step.
MONTHS = {"month": 1, "quarter": 3, "year": 12}
DAYS = {"day": 1, "week": 7}
ORDER = ["hour", "day", "week", "month", "quarter", "year"]


def series(df: DataFrame, time: str, measure: Column, keys: list[str] | None = None, granularity: str = "month") -> DataFrame:
    """Aggregate ``measure`` (an aggregate) by period and key, and number."""
    keys = keys or []
    start = F.date_trunc(granularity, F.col(time))
    start = start if granularity == "hour" else start.cast("date")
    found = df.groupBy(*keys, start.alias("t")).agg(measure.alias("y"))
    return number(found, keys)


def number(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t")
    return df.withColumn("x", F.row_number().over(w).cast("long"))


def granularity_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The granularity of each key by the distance of its first two times."""
    two = df.filter("x <= 2").groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    hours = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 3.6e9
    days = hours / 24
    kind = F.when(hours == 1, "hour").when(days == 1, "day").when(days == 7, "week").when(days.between(28, 31), "month").when(days.between(90, 92), "quarter").when(days.between(365, 366), "year")
    return two.select(*keys, kind.alias("granularity"))


def step(t: Column, k: Column, granularity: str) -> Column:
    """Time ``t`` after ``k`` single steps, each clamped to its month's end."""
    if granularity in MONTHS:
        return add_months_stepwise(t, k, MONTHS[granularity])
    if granularity in DAYS:
        return F.date_add(t, (k * DAYS[granularity]).cast("int"))
    return t + F.make_dt_interval(hours=k)


def check_equidistant(df: DataFrame, keys: list[str], granularity: str) -> DataFrame:
    """``df``, with an error where a row isn't one step behind the one before."""
    before = F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    wrong = before.isNotNull() & (F.col("t") != step(before, F.lit(1), granularity))
    return df.withColumn("t", F.when(wrong, F.raise_error(F.lit("the series has gaps"))).otherwise(F.col("t")))


def split(df: DataFrame, keys: list[str], held: int) -> tuple[DataFrame, DataFrame]:
    """All but the last ``held`` rows of each key, and those."""
    n = F.count("*").over(Window.partitionBy(*keys))
    told = df.withColumn("_n", n)
    return told.filter(F.col("x") <= F.col("_n") - held).drop("_n"), told.filter(F.col("x") > F.col("_n") - held).drop("_n")
