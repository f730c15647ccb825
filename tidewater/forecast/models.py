"""Models: training, forecasting, merging, disaggregation, error measures.

A models frame has the key columns, ``algorithm``, ``n``, ``last`` (the last
training time) and ``params`` (``map<string, array<double>>``).  The mean, the
regression line and simple smoothing are plain aggregates; the others are
fitted by numpy, one series a call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.forecast import numeric
from tidewater.forecast.series import step

ALIASES = {"holtwinters": "hwmodel", "arima": "armodel", "ets": "gnur", "mean": "medium", "auto_arima": "auto.arima"}


def _params(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.array(v.cast("double")))]
    return F.create_map(*pairs)


def train(series: DataFrame, keys: list[str], algorithm: str, **options: float) -> DataFrame:
    """One model a key.  ``medium``, ``linreg``, ``ses`` (alpha), ``hwmodel``
    (period, seasonal, trend), ``armodel`` (ar, d, ma, period, sar), ``gnur``."""
    algorithm = ALIASES.get(algorithm, algorithm)
    g = series.groupBy(*keys)
    ends = [F.count("*").alias("n"), F.max("t").alias("last")]
    y, x = F.col("y").cast("double"), F.col("x")
    if algorithm == "medium":
        found = g.agg(*ends, _params(sum=F.sum(y), count=F.count("*")).alias("params"))
    elif algorithm == "linreg":
        # one row can't have a slope: the line is flat then
        found = g.agg(*ends, _params(slope=F.coalesce(F.regr_slope(y, x), F.lit(0.0)), intercept=F.coalesce(F.regr_intercept(y, x), F.avg(y))).alias("params"))
    elif algorithm == "ses":
        a = float(options.get("alpha", 0.3))
        n = series.groupBy(*keys).agg(F.max("x").alias("_n"))
        told = series.join(n, keys) if keys else series.crossJoin(F.broadcast(n))  # one row without keys
        weight = F.when(x == 1, F.pow(F.lit(1 - a), F.col("_n") - 1)).otherwise(a * F.pow(F.lit(1 - a), F.col("_n") - x))
        found = told.groupBy(*keys).agg(*ends, _params(level=F.sum(weight * y), alpha=F.lit(a)).alias("params"))
    else:
        fields = [series.schema[k] for k in keys] + [T.StructField("n", T.LongType()), series.schema["t"], T.StructField("params", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))]
        fields[-2] = T.StructField("last", series.schema["t"].dataType)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("x")
            values = numeric.fit(algorithm, pdf["y"].to_numpy(float), options)
            row = {k: pdf[k].iloc[0] for k in keys} | {"n": len(pdf), "last": pdf["t"].iloc[-1], "params": {k: [float(i) for i in np.atleast_1d(v)] for k, v in values.items()}}
            return pd.DataFrame([row])

        found = g.applyInPandas(fit, T.StructType(fields))
    return found.withColumn("algorithm", F.lit(algorithm))


def forecast(models: DataFrame, steps: int, granularity: str = "month", measure: str | None = None) -> DataFrame:
    """Rows ``h`` = 1..steps of each model: ``t`` and ``value``.  ``measure``
    casts back to the type of the measure."""
    if steps > numeric.HORIZON:
        models = models.withColumn("params", _longer("params", F.lit(steps)))
    return _at(models.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps)))), granularity, measure)


def forecast_until(models: DataFrame, target: str, granularity: str = "month", measure: str | None = None, most: int = 100_000) -> DataFrame:
    """Steps while the time before the step is earlier than ``target``, which
    must be later than the last training time.  More than ``most`` steps are an
    error."""
    goal = F.lit(target).cast("date")
    if granularity == "hour":
        goal = F.lit(target).cast("timestamp_ntz")
    checked = models.withColumn("last", F.when(F.col("last") < goal, F.col("last")).otherwise(F.raise_error(F.lit("the target must lie behind the training data"))))
    days = {"hour": 1 / 24, "day": 1, "week": 7, "month": 28, "quarter": 89, "year": 365}[granularity]
    bound = (F.datediff(goal.cast("date"), F.col("last").cast("date")) / days).cast("int") + 2
    far = step(F.col("last"), F.lit(most), granularity) < goal
    checked = checked.withColumn("last", F.when(far, F.raise_error(F.lit(f"the target lies more than {most} steps ahead"))).otherwise(F.col("last")))
    checked = checked.withColumn("params", _longer("params", bound))
    rows = checked.withColumn("h", F.explode(F.sequence(F.lit(1), bound)))
    rows = rows.filter(step(F.col("last"), F.col("h") - 1, granularity) < goal)
    return _at(rows, granularity, measure)


@F.udf(T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
def _longer(params: dict[str, list[float]], steps: int) -> dict[str, list[float]]:
    """The parameters, with as long a path as is asked for if they are an ARIMA model's."""
    if not params or "path" not in params or steps is None or len(params["path"]) >= steps:
        return params
    path, spread = numeric.roll({k: v for k, v in params.items() if k not in ("path", "spread")}, steps)
    return params | {"path": [float(v) for v in path], "spread": [float(v) for v in spread]}


def _at(rows: DataFrame, granularity: str, measure: str | None) -> DataFrame:
    p, h = F.col("params"), F.col("h")
    one = lambda k: F.get(F.try_element_at(p, F.lit(k)), F.lit(0))
    season = F.try_element_at(p, F.lit("season"))
    size = F.size(season)
    turn = F.when(size > 0, F.get(season, ((h - 1) % F.greatest(size, F.lit(1))).cast("int")))
    damping = F.coalesce(one("damping"), F.lit(1.0))
    steps = F.when(damping == 1, h).otherwise(damping * (1 - F.pow(damping, h)) / F.nullif(1 - damping, F.lit(0.0)))
    line = one("level") + steps * F.coalesce(one("trend"), F.lit(0.0))
    smooth = F.when(one("multiplicative") == 1, line * F.coalesce(turn, F.lit(1.0))).otherwise(line + F.coalesce(turn, F.lit(0.0)))
    path = F.try_element_at(p, F.lit("path"))
    value = (
        F.when(F.col("algorithm") == "medium", one("sum") / one("count"))
        .when(F.col("algorithm") == "linreg", one("intercept") + one("slope") * (F.col("n") + h))
        .when(F.col("algorithm") == "ses", one("level"))
        .when(F.col("algorithm").isin("armodel", "auto.arima"), F.try_element_at(path, h))
        .otherwise(smooth)
    )
    half = F.try_element_at(F.try_element_at(p, F.lit("spread")), h)
    out = rows.withColumn("t", step(F.col("last"), h, granularity)).withColumn("value", value.cast(measure) if measure else value).withColumn("spread", half)
    return out.drop("params", "n", "last")


def explain(models: DataFrame, steps: int, keys: list[str] | None = None) -> DataFrame:
    """EXPLAIN of a forecast: a line for each model, with what it is made of."""
    names = F.array_join(F.array_sort(F.map_keys("params")), ", ")
    of = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys or []))
    head = F.concat(F.lit("Forecast  (algorithm="), F.col("algorithm"), F.lit(" steps="), F.lit(str(steps)), F.lit(" n="), F.col("n").cast("string"), F.lit(" after="), F.date_format("last", "yyyy-MM-dd"), F.lit(")"))
    return models.select(F.concat(head, F.lit("  Model: "), names, F.when(of != "", F.concat(F.lit("  Keys: "), of)).otherwise("")).alias("plan"))


def with_interval(forecasts: DataFrame, percent: float) -> DataFrame:
    """Half-widths of prediction intervals, for models that carry a spread."""
    z = numeric.quantile(0.5 + percent / 200)
    return forecasts.withColumn("half_width", F.col("spread") * z)


def merge(candidates: DataFrame, by: list[str], how: str = "first") -> DataFrame:
    """One value from several models' forecasts (columns ``ordinal``, ``value``
    and for ``sum_key`` ``key``)."""
    v = F.col("value")
    found = {"first": F.min_by(v, "ordinal"), "last": F.max_by(v, "ordinal"), "avg": F.avg(v), "sum": F.sum(v)}
    if how == "sum_key":
        found["sum_key"] = F.sum(v * F.col("key"))
    return candidates.groupBy(*by).agg(found[how].alias("value"))


def disaggregate(df: DataFrame, value: str, keys: dict[str, float], how: str, attribute: str = "attribute") -> DataFrame:
    """Each row once for each attribute value, the measure combined with its
    key by mul, div, add or sub; a single value adds no attribute column."""
    if how == "div" and 0 in keys.values():
        raise ZeroDivisionError("a key is zero")
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("x")) for k, x in keys.items()))
    rows = df.withColumn("_pair", F.explode(pairs))
    x = F.col("_pair.x")
    v = F.col(value)
    rows = rows.withColumn(value, {"mul": v * x, "div": v / x, "add": v + x, "sub": v - x}.get(how, v))
    return (rows.withColumn(attribute, F.col("_pair.k")) if len(keys) > 1 else rows).drop("_pair")


def sse(x: Column, guess: Column) -> Column:
    return (x - guess) * (x - guess)


def abs_error(x: Column, guess: Column) -> Column:
    return F.abs(x - guess)


def smape(x: Column, guess: Column) -> Column:
    """Between 0 and 1; both zero is 0; a negative guess is 1 where the value
    is 0, else 0."""
    return F.when((x == 0) & (guess == 0), 0.0).when(guess < 0, F.when(x == 0, 1.0).otherwise(0.0)).otherwise(F.abs(guess - x) / (guess + x))
