"""The table of models: storing, naming and matching."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def predicate_key(conditions: list[tuple[str, str, object]]) -> str:
    """A canonical text for a conjunction of (column, operator, value)."""
    return " and ".join(f"{c} {op} {sorted(map(str, v)) if isinstance(v, (list, tuple, set)) else v}" for c, op, v in sorted(conditions, key=str))


def describe(models: DataFrame, table: str, time: str, measure: str, granularity: str, aggregate: str, where: list[tuple[str, str, object]] | None = None, options: dict[str, float] | None = None, name: str | None = None) -> DataFrame:
    """Models with what they were trained on; named table_measure_algorithm, or
    as told."""
    told = {"table": table, "time": time, "measure": measure, "granularity": granularity, "aggregate": aggregate, "predicate": predicate_key(where or []), "options": options_key(options)}
    named = F.lit(name) if name else F.concat_ws("_", F.lit(table), F.lit(measure), F.col("algorithm"))
    return models.withColumns({k: F.lit(v) for k, v in told.items()} | {"enabled": F.lit(True), "name": named})


def options_key(options: dict[str, float] | None) -> str:
    return ", ".join(f"{k}={float(v):g}" for k, v in sorted((options or {}).items()))


def store(models: DataFrame, path: str) -> None:
    """Adds models; a name that the catalog has already is an error."""
    names = [r["name"] for r in models.select("name").distinct().collect()]
    try:
        known = {r["name"] for r in restore(models.sparkSession, path).filter(F.col("name").isin(names)).select("name").distinct().collect()}
    except AnalysisException:  # no catalog yet
        known = set()
    if known:
        raise ValueError(f"a model of this name exists: {', '.join(sorted(known))}")
    models.write.mode("append").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def match(models: DataFrame, table: str, time: str, measure: str, granularity: str, aggregate: str, where: list[tuple[str, str, object]] | None = None, algorithm: str | None = None, options: dict[str, float] | None = None) -> DataFrame:
    """Enabled models of the same training data; any algorithm and any options
    if none are named."""
    found = models.filter("enabled")
    for c, v in (("table", table), ("time", time), ("measure", measure), ("granularity", granularity), ("aggregate", aggregate), ("predicate", predicate_key(where or []))):
        found = found.filter(F.col(c) == v)
    if options is not None:
        found = found.filter(F.col("options") == options_key(options))
    return found if algorithm is None else found.filter(F.col("algorithm") == algorithm)
