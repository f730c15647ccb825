"""The model graph: a lattice of aggregated series, and the greedy advisor.

Nodes are the grouping sets of the dimensions: a null dimension stands for all
its values.  One ``cube`` builds all nodes' series and one grouped call trains
them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.forecast import numeric
from tidewater.forecast.series import number

ALL = "*"


def nodes(df: DataFrame, dims: list[str], time: Column, measure: Column) -> DataFrame:
    """dims (``*`` for all), level (grouping id), t, y, x.  Null values of a
    dimension are a value of their own, written ``?``; values that begin with one
    of these signs or a backslash are written with a backslash before them."""
    base = df.select(*(written(F.col(d)).alias(d) for d in dims), time.alias("t"), measure.alias("_y"))
    sets = base.groupBy(*dims, "t").agg(F.sum("_y").alias("_y"))  # once by the finest node; the cube adds those sums
    cubed = sets.cube(*dims, "t").agg(F.grouping_id().cast("long").alias("_id"), F.sum("_y").alias("y"))
    kept = cubed.filter(F.col("_id") % 2 == 0).withColumn("level", F.shiftright("_id", 1)).drop("_id")  # t itself is always grouped
    return number(kept.fillna(ALL, dims), dims)


def written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(r"^[*?\\]"), F.concat(F.lit("\\"), text)).otherwise(text), F.lit("?"))


def targets(graph: DataFrame, dims: list[str], conditions: dict[str, list[str]]) -> DataFrame:
    """The nodes that a predicate needs: ``conditions`` gives for a dimension the
    values of an equality or IN; a dimension without one is taken as a whole."""
    found = graph.select(*dims, "level").distinct()
    for d in dims:
        wanted = conditions.get(d)
        found = found.filter(F.col(d) == ALL if wanted is None else F.col(d).isin([("\\" + v) if v[:1] in ("*", "?", "\\") else v for v in wanted]))
    return found


def sources(wanted: DataFrame, models: DataFrame, dims: list[str]) -> DataFrame:
    """For each wanted node the nearest node above it that has a model: the one
    that takes the fewest dimensions as a whole."""
    up = ancestors(wanted, dims)
    s_dims = [f"s_{d}" for d in dims]
    owned = models.select(*(F.col(d).alias(f"s_{d}") for d in dims)).distinct()
    wide = sum((F.when(F.col(d) == ALL, 1).otherwise(0) for d in s_dims), F.lit(0))
    return up.join(owned, s_dims).groupBy(*dims).agg(F.min_by(F.struct(*s_dims), F.struct(wide, *s_dims)).alias("source")).select(*dims, "source.*")


def down(forecasts: DataFrame, scheme: DataFrame, dims: list[str]) -> DataFrame:
    """DISAGGSCHEME: forecasts of sources by fixed keys on the edges (dims,
    s_dims, key)."""
    named = forecasts.select(*(F.col(d).alias(f"s_{d}") for d in dims), *(c for c in forecasts.columns if c not in dims))
    return scheme.join(named, [f"s_{d}" for d in dims]).withColumn("value", F.col("value") * F.col("key")).drop("key", *(f"s_{d}" for d in dims))


def upward(forecasts: DataFrame, scheme: DataFrame, dims: list[str], by: list[str]) -> DataFrame:
    """AGGSCHEME: forecasts of targets summed by fixed keys into their sources;
    ``by`` names the columns of a step."""
    joined = scheme.join(forecasts, dims).groupBy(*(f"s_{d}" for d in dims), *by).agg(F.sum(F.col("value") * F.col("key")).alias("value"))
    return joined.select(*(F.col(f"s_{d}").alias(d) for d in dims), *by, "value")


def store(graph: DataFrame, models: DataFrame, path: str) -> None:
    """STORE MODELGRAPH: nodes and models side by side."""
    graph.write.parquet(f"{path}/nodes")
    models.write.parquet(f"{path}/models")


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/models")


def fill(graph: DataFrame, dims: list[str], strategy: str) -> DataFrame:
    """Nodes that own models: ``topdown`` the node of all, ``bottomup`` the
    finest nodes, ``complete`` every node."""
    top = 2 ** len(dims) - 1
    return {"topdown": graph.filter(F.col("level") == top), "bottomup": graph.filter("level = 0"), "complete": graph}[strategy]


def disaggregation_keys(graph: DataFrame, dims: list[str]) -> DataFrame:
    """Each finest node's share of the node of all: sum by sum."""
    totals = graph.groupBy(*dims, "level").agg(F.sum("y").alias("total"))
    top = totals.filter(F.col("level") == 2 ** len(dims) - 1).select(F.col("total").alias("_all"))
    return totals.filter("level = 0").crossJoin(F.broadcast(top)).withColumn("share", F.col("total") / F.col("_all")).drop("_all", "level")  # one row


def ancestors(graph: DataFrame, dims: list[str]) -> DataFrame:
    """source and target nodes: a source covers its targets, dimension by
    dimension the same value or all.  Built by exploding each node's own
    ancestors, not by pairing nodes."""
    own = graph.select(*dims).distinct()
    choices = F.array(F.struct(*(F.col(d).alias(f"s_{d}") for d in dims)))
    for d in dims:
        choices = F.array_union(choices, F.transform(choices, _all_of(f"s_{d}")))
    return own.withColumn("_s", F.explode(choices)).select(*dims, "_s.*")


def _all_of(name: str) -> Callable[[Column], Column]:
    return lambda s: s.withField(name, F.lit(ALL))


def rolling_errors(graph: DataFrame, dims: list[str], held: int, algorithm: str = "linreg") -> DataFrame:
    """source, target, error: the mean SMAPE over the last ``held`` points of
    each target, forecast one step ahead by the source's model and scaled by
    the target's share of the source so far.

    Each (source, target) pair is one group of two short series.
    """
    pairs = ancestors(graph, dims)
    source = graph.select(*(F.col(d).alias(f"s_{d}") for d in dims), F.col("t"), F.col("y").alias("sy"))
    target = graph.select(*dims, "t", F.col("y").alias("ty"))
    s_dims = [f"s_{d}" for d in dims]
    joined = pairs.join(source, s_dims).join(target, [*dims, "t"], "left").fillna(0.0, ["ty"])

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s, y = pdf["sy"].to_numpy(float), pdf["ty"].to_numpy(float)
        found = []
        for i in range(max(len(s) - held, 2), len(s)):
            guess = one_step(s[:i], algorithm)
            whole = s[:i].sum()
            guess *= y[:i].sum() / whole if whole else 0.0
            found.append(smape(y[i], guess))
        row = {d: pdf[d].iloc[0] for d in [*dims, *s_dims]} | {"error": float(np.mean(found)) if found else 1.0}
        return pd.DataFrame([row])

    schema = ", ".join(f"{d} string" for d in [*dims, *s_dims]) + ", error double"
    return joined.groupBy(*dims, *s_dims).applyInPandas(errors, schema)


def one_step(y: np.ndarray, algorithm: str) -> float:
    if algorithm == "medium":
        return float(y.mean())
    if algorithm == "linreg":
        x = np.arange(1, len(y) + 1)
        slope = np.cov(x, y, bias=True)[0, 1] / x.var() if len(y) > 1 else 0.0
        return float(y.mean() + slope * (len(y) + 1 - x.mean()))
    if algorithm == "armodel":
        return float(numeric.fit_arima(y, horizon=1)["path"][0])
    state = numeric.fit_holt_winters(y)
    return float(state["level"][0] + state["trend"][0])


def smape(x: float, guess: float) -> float:
    if x == 0 and guess == 0:
        return 0.0
    if guess < 0:
        return 1.0 if x == 0 else 0.0
    return abs(guess - x) / (guess + x)


def greedy(errors: pd.DataFrame, dims: list[str], alpha: float = 0.5) -> tuple[list[tuple], list[float]]:
    """Sources that own models, and the objective after each choice.

    Starts with the node of all; each round adds the model that lowers
    ``alpha * error / first error + (1 - alpha) * (models - 1) / (nodes - 1)``
    most.  ``errors`` is a matrix of nodes, not of data.
    """
    targets = sorted(set(map(tuple, errors[dims].values)))
    sources = sorted(set(map(tuple, errors[[f"s_{d}" for d in dims]].values)))
    at = {t: i for i, t in enumerate(targets)}
    matrix = np.full((len(sources), len(targets)), np.inf)
    where = {s: i for i, s in enumerate(sources)}
    for row in errors.itertuples(index=False):
        values = row._asdict()
        matrix[where[tuple(values[f"s_{d}"] for d in dims)], at[tuple(values[d] for d in dims)]] = values["error"]
    root = where[(ALL,) * len(dims)]
    chosen, best = [root], matrix[root].copy()
    first = max(best.mean(), 1e-12)

    def objective(e: np.ndarray, n: int) -> float:
        return alpha * e.mean() / first + (1 - alpha) * (n - 1) / max(len(sources) - 1, 1)

    path = [objective(best, 1)]
    while len(chosen) < len(sources):
        rest = [i for i in range(len(sources)) if i not in chosen]
        values = [objective(np.minimum(best, matrix[i]), len(chosen) + 1) for i in rest]
        k = int(np.argmin(values))
        if values[k] >= path[-1]:
            break
        chosen.append(rest[k])
        best = np.minimum(best, matrix[rest[k]])
        path.append(values[k])
    return [sources[i] for i in chosen], path


def assign(errors: DataFrame, dims: list[str], chosen: list[tuple]) -> DataFrame:
    """For each node the chosen source with the least error."""
    s_dims = [f"s_{d}" for d in dims]
    picked = errors.sparkSession.createDataFrame(chosen, ", ".join(f"{d} string" for d in s_dims))
    return errors.join(picked, s_dims).groupBy(*dims).agg(F.min_by(F.struct(*s_dims), F.struct("error", *s_dims)).alias("source"), F.min("error").alias("error")).select(*dims, "source.*", "error")
