"""Additive decomposition into trend, season and rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decompose(series: DataFrame, keys: list[str], window: int, period: int, exact: bool = False) -> DataFrame:
    """``series`` with trend, season and rest.

    The trend is a centred moving mean over ``window`` rows (one more if even,
    the ends with half weight).  The divisor stays the number of rows even
    then, so the trend is a little low; ``exact`` divides by the weights' sum.
    The first and last rows take the nearest trend.  The season is the mean of
    what is left by place in the period, not centred.
    """
    wide = window if window % 2 else window + 1
    k = wide // 2
    by = Window.partitionBy(*keys).orderBy("x")
    n = F.count("*").over(Window.partitionBy(*keys))
    y = F.col("y").cast("double")
    total = F.sum(y).over(by.rowsBetween(-k, k))
    if window % 2 == 0:
        total = total - (F.lag(y, k).over(by) + F.lead(y, k).over(by)) / 2
    divisor = window if exact and window % 2 == 0 else wide
    told = series.withColumn("_n", n).withColumn("_mean", total / divisor)
    inside = F.col("x").between(k + 1, F.col("_n") - k)
    whole = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = told.withColumn("_in", F.when(inside, F.col("_mean")))
    told = told.withColumn("trend", F.when(F.col("x") <= k, F.first("_in", ignorenulls=True).over(whole)).when(F.col("x") > F.col("_n") - k, F.last("_in", ignorenulls=True).over(whole)).otherwise(F.col("_mean")))
    told = told.withColumn("_place", (F.col("x") - 1) % period)
    told = told.withColumn("season", F.avg(y - F.col("trend")).over(Window.partitionBy(*keys, "_place")))
    return told.withColumn("rest", y - F.col("trend") - F.col("season")).drop("_n", "_mean", "_in", "_place")
