"""Window functions whose offset is a column.

Spark wants constant offsets.  Rows are numbered within their partition and
joined to the row that the offset names; both sides share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ordering import keys


def _at(df: DataFrame, by: list[str], order: list[str | Column], value: str, place: Column, name: str, default: Column | None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*keys(*order))
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_at", place)
    other = ranked.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), F.col("_rn").alias("_on"), F.col(value).alias(name), F.lit(True).alias("_met"))
    on = F.col("_at") == F.col("_on")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_{i}"))
    found = ranked.join(other, on, "left")
    if default is not None:
        found = found.withColumn(name, F.when(F.col("_met"), F.col(name)).when(F.col("_at").isNotNull(), default))
    return found.select(*df.columns, name)


def lag(df: DataFrame, by: list[str], order: list[str | Column], value: str, offset: str, name: str, default: Column | None = None) -> DataFrame:
    """``value`` of the row ``offset`` (a column) rows before; null for a null
    offset, ``default`` where there is no such row."""
    return _at(df, by, order, value, F.col("_rn") - F.col(offset), name, default)


def lead(df: DataFrame, by: list[str], order: list[str | Column], value: str, offset: str, name: str, default: Column | None = None) -> DataFrame:
    return _at(df, by, order, value, F.col("_rn") + F.col(offset), name, default)


def nth_value(df: DataFrame, by: list[str], order: list[str | Column], value: str, n: str, name: str) -> DataFrame:
    """``value`` of row ``n`` (a column) of the frame up to the current row."""
    return _at(df, by, order, value, F.when(F.col(n) <= F.col("_rn"), F.col(n)), name, None)
