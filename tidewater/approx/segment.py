"""Model-backed relations: values computed from a tree of trend lines.

Layer 0 fits one line to a whole series, each further layer cuts every segment
into ``fanout`` parts.  A node carries the 90th percentile of its absolute
errors; a scan at an error level takes, for each row, the highest node whose
error is below it.  Seasons are means of what layer 0 leaves, by place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.forecast import smoothers


def build(series: DataFrame, keys: list[str], layers: int = 3, fanout: int = 4, frequency: int = 1) -> DataFrame:
    """Nodes: keys, layer, segment, slope, intercept, error, seasons.

    ``series`` has ``x`` from 1; positions count from 0.  All layers are one
    grouping: each row is exploded to the segments it lies in.
    """
    ends = series.groupBy(*keys).agg(F.max("x").alias("_n"))
    told = series.join(ends, keys) if keys else series.crossJoin(F.broadcast(ends))  # one row without keys
    p = F.col("x") - 1
    told = told.select(*keys, p.alias("p"), F.col("y").cast("double").alias("y"), "_n")
    if frequency > 1:
        line = told.groupBy(*keys).agg(F.coalesce(F.regr_slope("y", "p"), F.lit(0.0)).alias("_b"), F.coalesce(F.regr_intercept("y", "p"), F.avg("y")).alias("_a"))
        left = told.join(line, keys) if keys else told.crossJoin(F.broadcast(line))
        season = left.groupBy(*keys, (F.col("p") % frequency).alias("_place")).agg(F.avg(F.col("y") - F.col("_a") - F.col("_b") * F.col("p")).alias("_s"))
        told = told.withColumn("_place", F.col("p") % frequency).join(season, [*keys, "_place"]).withColumn("y", F.col("y") - F.col("_s"))
    else:
        told = told.withColumn("_s", F.lit(0.0)).withColumn("_place", F.lit(0).cast("long"))
    parts = told.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).withColumn("segment", segment(F.col("p"), F.col("_n"), F.col("layer"), fanout))
    by = [*keys, "layer", "segment"]
    fits = parts.groupBy(*by).agg(F.coalesce(F.regr_slope("y", "p"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("y", "p"), F.avg("y")).alias("intercept"), F.max("_n").alias("n"))
    missed = parts.join(fits.drop("n"), by).withColumn("_e", F.abs(F.col("y") - F.col("intercept") - F.col("slope") * F.col("p")))
    errors = missed.groupBy(*by).agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY _e)").alias("error"))
    nodes = fits.join(errors, by)
    if frequency > 1:
        lists = season.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_s"))).alias("seasons"))
        return nodes.join(lists, keys) if keys else nodes.crossJoin(F.broadcast(lists))
    return nodes.withColumn("seasons", F.lit(None).cast("map<bigint,double>"))


def segment(p: Column, n: Column, layer: Column, fanout: int) -> Column:
    """The segment of position ``p`` in a layer: p * fanout^layer / n."""
    return F.floor(p * F.pow(F.lit(fanout), layer).cast("long") / n).cast("long")


def scan(nodes: DataFrame, keys: list[str], error: float | None = None, layer: int | None = None, frequency: int = 1, fanout: int = 4, first: int = 0, last: int | None = None) -> DataFrame:
    """keys, p, value, layer: rows ``first``..``last`` computed from the model.

    ``error`` takes the highest node with a smaller error, else the deepest;
    ``layer`` takes that layer (the deepest if there are fewer).
    """
    sizes = nodes.filter("layer = 0").select(*keys, "n")
    stop = F.col("n") - 1 if last is None else F.least(F.col("n") - 1, F.lit(last))
    rows = sizes.filter(stop >= first).withColumn("p", F.explode(F.sequence(F.lit(first).cast("long"), stop)))
    deepest = nodes.agg(F.max("layer")).first()[0] or 0
    levels = range(deepest + 1) if layer is None else [min(layer, deepest)]
    rows = rows.withColumn("layer", F.explode(F.array(*(F.lit(i) for i in levels)))).withColumn("segment", segment(F.col("p"), F.col("n"), F.col("layer"), fanout)).drop("n")
    found = rows.join(nodes.drop("n"), [*keys, "layer", "segment"])
    season = F.coalesce(F.try_element_at("seasons", F.col("p") % frequency), F.lit(0.0))
    found = found.withColumn("value", F.col("intercept") + F.col("slope") * F.col("p") + season)
    if layer is not None or error is None:
        return found.filter(F.col("layer") == levels[-1]).select(*keys, "p", "value", "layer")
    rank = F.when(F.col("error") < error, F.col("layer")).otherwise(F.lit(deepest + 1) - F.col("layer") / (deepest + 1))
    best = found.groupBy(*keys, "p").agg(F.min_by(F.struct("value", "layer"), rank).alias("_b"))
    return best.select(*keys, "p", "_b.value", "_b.layer")


def grouped(rows: DataFrame, keys: list[str], length: int, how: str) -> DataFrame:
    """Runs of ``length`` rows: s sum, a avg, m max, M min, n last; whole numbers."""
    v = F.col("value")
    found = {"s": F.sum(v), "a": F.avg(v), "m": F.max(v), "M": F.min(v), "n": F.max_by(v, "p")}[how]
    return rows.groupBy(*keys, F.floor(F.col("p") / length).alias("run")).agg(found.cast("long").alias("value"))


def append(nodes: DataFrame, keys: list[str], fresh: DataFrame, layers: int = 3, fanout: int = 4, frequency: int = 1) -> DataFrame:
    """Nodes of appended data as further parts: ``fresh`` has ``x`` going on
    behind what the nodes cover; its tree stands beside theirs, its positions
    counted from its own start (``offset``)."""
    starts = fresh.groupBy(*keys).agg(F.min("x").alias("_x0")) if keys else fresh.agg(F.min("x").alias("_x0"))
    moved = (fresh.join(starts, keys) if keys else fresh.crossJoin(F.broadcast(starts))).withColumn("x", F.col("x") - F.col("_x0") + 1)
    more = build(moved.drop("_x0"), keys, layers, fanout, frequency)
    more = (more.join(starts, keys) if keys else more.crossJoin(F.broadcast(starts))).withColumn("offset", F.col("_x0") - 1).drop("_x0")
    known = nodes if "offset" in nodes.columns else nodes.withColumn("offset", F.lit(0).cast("long"))
    return known.unionByName(more)


def scan_parts(nodes: DataFrame, keys: list[str], layer: int, frequency: int = 1, fanout: int = 4) -> DataFrame:
    """keys, p, value of a relation with appended parts."""
    return scan(nodes.withColumn("_part", F.col("offset")), [*keys, "_part"], layer=layer, frequency=frequency, fanout=fanout).withColumn("p", F.col("p") + F.col("_part")).select(*keys, "p", "value")


def minimax(series: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """keys, segment, slope, intercept, error: in each of ``parts`` segments of a
    series the line whose largest error is least."""
    ends = series.groupBy(*keys).agg(F.max("x").alias("_n"))
    told = (series.join(ends, keys) if keys else series.crossJoin(F.broadcast(ends))).withColumn("segment", F.floor((F.col("x") - 1) * parts / F.col("_n")).cast("long"))
    fields = [series.schema[k] for k in keys] + [T.StructField("segment", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("slope", "intercept", "error")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        slope, intercept, error = smoothers.minimax_line(pdf["y"].to_numpy(float))
        first = float(pdf["x"].iloc[0]) - 1
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in [*keys, "segment"]} | {"slope": slope, "intercept": intercept - slope * first, "error": error}])

    return told.select(*keys, "segment", "x", "y").groupBy(*keys, "segment").applyInPandas(fit, T.StructType(fields))


def seasons(series: DataFrame, keys: list[str], periods: list[int]) -> DataFrame:
    """keys, x, trend, season_0, ...: each period's season is taken out by local
    regression before the next, longer one is.  A period of which there are not
    two leaves no season."""
    fields = [series.schema[k] for k in keys] + [series.schema["x"]] + [T.StructField(c, T.DoubleType()) for c in ("trend", *(f"season_{i}" for i in range(len(periods))))]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        rest = pdf["y"].to_numpy(float)
        out = {k: pdf[k].to_numpy() for k in [*keys, "x"]}
        trend = rest
        for i, period in enumerate(sorted(periods)):
            if len(rest) < 2 * period:
                out[f"season_{i}"] = 0.0
                continue
            trend, out[f"season_{i}"] = smoothers.stl(rest, period)
            rest = rest - out[f"season_{i}"]
        return pd.DataFrame(out | {"trend": trend})

    return series.select(*keys, "x", "y").groupBy(*keys).applyInPandas(split, T.StructType(fields))


def write_tree(nodes: DataFrame, path: str) -> None:
    nodes.write.parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
