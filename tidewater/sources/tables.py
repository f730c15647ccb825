"""Reading and writing tables: Parquet, delimited text, inline rows, series."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one only where
    that is unset and the session runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _test_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def copy_to(df: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N", csv: bool = False, header: bool = False, force_quote: bool = False) -> None:
    """Bulk unload as text or CSV; nulls are written as ``null``."""
    writer = df.write.option("sep", delimiter).option("nullValue", null).option("header", header).option("emptyValue", '""' if csv else "")
    if csv:
        writer = writer.option("quoteAll", force_quote).option("escape", '"')
    else:
        writer = writer.option("quote", "\u0000")
    writer.csv(path)


def copy_from(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = "\\N", csv: bool = False, header: bool = False) -> DataFrame:
    """Bulk load of text or CSV with a given schema; a row that doesn't fit it
    is an error, as in COPY."""
    reader = spark.read.schema(schema).option("sep", delimiter).option("nullValue", null).option("header", header).option("mode", "FAILFAST")
    reader = reader.option("escape", '"') if csv else reader.option("quote", "")
    return reader.csv(path)


def generate_series(start: Column | int, stop: Column | int, step: int = 1) -> Column:
    """An array to explode: empty where the bounds run against the step."""
    if step == 0:
        raise ValueError("step size cannot be zero")
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (start, stop))
    runs = a <= b if step > 0 else a >= b
    return F.when(runs, F.sequence(a, F.when(runs, b).otherwise(a), F.lit(step).cast("long"))).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.array().cast("array<bigint>"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def with_children(parent: DataFrame, children: dict[str, DataFrame], own: str, only: bool = False) -> DataFrame:
    """An inheritance tree: the parent's columns of its own and its children's
    rows, each with the name of its table; ``only`` leaves the children out."""
    found = parent.withColumn("tableoid", F.lit(own))
    if only:
        return found
    for name, child in children.items():
        found = found.unionByName(child.select(*parent.columns).withColumn("tableoid", F.lit(name)))
    return found


def from_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a query on another database."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
