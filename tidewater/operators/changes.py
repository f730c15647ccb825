"""INSERT, UPDATE, DELETE and TRUNCATE as rewrites of a table.

Each function returns the table as it is afterwards and the rows that the
statement touched (RETURNING).  ``replace_table`` writes a table's new state to a
fresh version folder and then moves a small pointer file, so readers see either
state whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` may lack columns: those take their default, or null."""
    given = defaults or {}
    if unknown := set(rows.columns) - set(table.columns):
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    new = rows.select(*((F.col(f.name) if f.name in rows.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema))
    return table.union(new), new


def update(table: DataFrame, changes: dict[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for which ``where`` is true get the new values, all computed from
    the old row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    kind = {f.name: f.dataType for f in table.schema}
    marked = table.withColumn("_hit", hit)
    done = marked.select(*(F.when(F.col("_hit"), changes[c].cast(kind[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns), "_hit")
    return done.drop("_hit"), done.filter("_hit").drop("_hit")


def update_from(table: DataFrame, source: DataFrame, on: list[str], changes: dict[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE ... FROM: rows with a partner in ``source`` get values that may name
    its columns.  A row with several partners takes one, the least in order of
    its columns."""
    more = [c for c in source.columns if c not in on]
    if clash := set(more) & set(table.columns):
        raise ValueError(f"ambiguous column: {', '.join(sorted(clash))}")
    usable = source.filter(F.coalesce(where, F.lit(False))) if where is not None else source
    one = usable.groupBy(*on).agg(F.min(F.struct(*more)).alias("_from"))
    joined = table.join(one, on, "left").withColumn("_hit", F.col("_from").isNotNull()).select(*table.columns, "_hit", "_from.*")
    done, changed = update(joined, changes, F.col("_hit"))
    return done.select(*table.columns), changed.select(*table.columns)


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    gone = F.coalesce(where, F.lit(False))
    return table.filter(~gone), table.filter(gone)


def delete_using(table: DataFrame, source: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """DELETE ... USING: rows with a partner go, each once."""
    return table.join(source, on, "left_anti"), table.join(source, on, "left_semi")


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def replace_table(table: DataFrame, path: str) -> None:
    """The new state of the table kept at ``path``: a version folder, named by a
    row that replaces the one before it."""
    version = uuid.uuid4().hex
    table.write.parquet(f"{path}/{version}")
    table.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def current_table(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/current").first()["version"]
    return spark.read.parquet(f"{path}/{version}")
