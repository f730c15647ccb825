"""Queries that forecast, decompose, merge, disaggregate and measure errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.forecast import models
from tidewater.forecast.decompose import decompose
from tidewater.forecast.series import granularity_of, series, split
from tidewater.plans.base import Plans
from tidewater.sources.tables import load

PLANS = Plans()

#: Monthly revenue, in whole units so that both engines add the same numbers.
_S = "s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS y FROM orders GROUP BY 1), r AS (SELECT t, y, row_number() OVER (ORDER BY t) AS x FROM s)"
_M = "m AS (SELECT count(*) AS n, max(t) AS last, avg(y) AS mean, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r)"
_NEXT = "CAST(CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS VARCHAR)"


def revenue(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    orders = load(spark, sf, "orders")
    return series(orders, "o_orderdate", F.sum(F.round("o_totalprice").cast("long")), keys)


def _shown(df: DataFrame, *more: str, digits: int = 2) -> DataFrame:
    return df.select(*more, F.col("h").cast("long").alias("h"), F.col("t").cast("string").alias("t"), F.round("value", digits).alias("value"))


@PLANS.query(f"WITH {_S}, {_M} SELECT h, {_NEXT} AS t, round(mean, 6) AS value FROM m, range(1, 7) g(h)")
def fc_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.forecast(models.train(revenue(spark, sf), [], "medium"), 6), digits=6)


@PLANS.query(f"WITH {_S}, {_M} SELECT h, {_NEXT} AS t, round(a + b * (n + h), 2) AS value FROM m, range(1, 7) g(h)")
def fc_linreg(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order revenue, six months ahead."""
    return _shown(models.forecast(models.train(revenue(spark, sf), [], "linreg"), 6))


@PLANS.query("""WITH s AS (SELECT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(CAST(round(o_totalprice) AS BIGINT)) AS y FROM orders GROUP BY 1, 2),
r AS (SELECT k, t, y, row_number() OVER (PARTITION BY k ORDER BY t) AS x FROM s), m AS (SELECT k, count(*) AS n, max(t) AS last, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r GROUP BY 1)
SELECT k AS o_orderpriority, h, CAST(CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS VARCHAR) AS t, round(a + b * (n + h), 2) AS value FROM m, range(1, 4) g(h)""")
def fc_linreg_by_key(spark: SparkSession, sf: str) -> DataFrame:
    s = revenue(spark, sf, ["o_orderpriority"])
    return _shown(models.forecast(models.train(s, ["o_orderpriority"], "linreg"), 3), "o_orderpriority")


@PLANS.query(f"""WITH {_S}, {_M} SELECT h, {_NEXT} AS t, round((SELECT sum(CASE WHEN x = 1 THEN power(0.7, n - 1) ELSE 0.3 * power(0.7, n - x) END * y) FROM r), 2) AS value FROM m, range(1, 4) g(h)""")
def fc_ses(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.forecast(models.train(revenue(spark, sf), [], "ses", alpha=0.3), 3))


@PLANS.query(f"WITH {_S}, {_M} SELECT h, {_NEXT} AS t, round(a + b * (n + h), 2) AS value FROM m, range(1, 100) g(h) WHERE last + to_months(CAST(h - 1 AS INTEGER)) < DATE '2002-05-15'")
def fc_target_date(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(models.forecast_until(models.train(revenue(spark, sf), [], "linreg"), "2002-05-15"))


@PLANS.query("""SELECT 'day' AS g UNION ALL SELECT 'week' UNION ALL SELECT 'month' UNION ALL SELECT 'quarter' UNION ALL SELECT 'year'""")
def fc_granularity(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    parts = [granularity_of(series(orders, "o_orderdate", F.count("*"), [], g), []) for g in ("week", "month", "quarter", "year")]
    events = granularity_of(series(load(spark, sf, "events"), "ts", F.count("*"), [], "day"), [])
    for p in parts:
        events = events.union(p)
    return events.withColumnRenamed("granularity", "g")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = revenue(spark, sf)
    found = None
    for i, (name, key) in enumerate((("medium", 0.25), ("linreg", 0.75))):
        one = models.forecast(models.train(s, [], name), 3).select("h", "t", "value", F.lit(i).alias("ordinal"), F.lit(key).alias("key"))
        found = one if found is None else found.union(one)
    return found


_MERGED = {"first": "mean", "last": "a + b * (n + h)", "avg": "(mean + a + b * (n + h)) / 2", "sum": "mean + a + b * (n + h)", "sum_key": "mean * 0.25 + (a + b * (n + h)) * 0.75"}
for _how, _sql in _MERGED.items():

    def _merge(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return _shown(models.merge(_candidates(spark, sf), ["h", "t"], how), digits=4)

    _merge.__name__ = f"fc_merge_{_how}"
    PLANS.query(f"WITH {_S}, {_M} SELECT h, {_NEXT} AS t, round({_sql}, 4) AS value FROM m, range(1, 4) g(h)")(_merge)

_KEYS = {"A": 0.5, "B": 0.25, "C": 2.0}
for _how, _op in (("mul", "*"), ("div", "/"), ("add", "+"), ("sub", "-")):

    def _disagg(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        rows = models.forecast(models.train(revenue(spark, sf), [], "medium"), 2)
        return _shown(models.disaggregate(rows, "value", _KEYS, how), "attribute", digits=6)

    _disagg.__name__ = f"fc_disagg_{_how}"
    PLANS.query(f"WITH {_S}, {_M} SELECT k AS attribute, h, {_NEXT} AS t, round(mean {_op} f, 6) AS value FROM m, range(1, 3) g(h), (VALUES ('A', 0.5::DOUBLE), ('B', 0.25::DOUBLE), ('C', 2.0::DOUBLE)) v(k, f)")(_disagg)


def _decompose_sql(window: int, period: int) -> str:
    wide = window if window % 2 else window + 1
    k = wide // 2
    ends = "" if window % 2 else f" - (lag(y, {k}) OVER o + lead(y, {k}) OVER o) / 2.0"
    return f"""WITH {_S}, c AS (SELECT *, count(*) OVER () AS n, (sum(y) OVER (ORDER BY x ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING){ends}) / {wide}.0::DOUBLE AS m FROM r WINDOW o AS (ORDER BY x)),
d AS (SELECT *, CASE WHEN x <= {k} THEN (SELECT m FROM c WHERE x = {k + 1}) WHEN x > n - {k} THEN (SELECT m FROM c WHERE x = n - {k}) ELSE m END AS trend FROM c),
e AS (SELECT *, avg(y - trend) OVER (PARTITION BY (x - 1) % {period}) AS season FROM d)
SELECT x, CAST(t AS VARCHAR) AS t, round(trend, 2) AS trend, round(season, 2) AS season, round(y - trend - season, 2) AS rest FROM e"""


def _parts(df: DataFrame) -> DataFrame:
    return df.select("x", F.col("t").cast("string").alias("t"), *(F.round(c, 2).alias(c) for c in ("trend", "season", "rest")))


@PLANS.query(_decompose_sql(5, 12))
def fc_decompose_odd(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(decompose(revenue(spark, sf), [], 5, 12))


@PLANS.query(_decompose_sql(12, 12))
def fc_decompose_even(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(decompose(revenue(spark, sf), [], 12, 12))


_HELD = f"""WITH {_S}, q AS (SELECT *, count(*) OVER () AS n FROM r), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM q WHERE x <= n - 6),
e AS (SELECT x, y, a + b * x AS g FROM q, m WHERE x > n - 6)"""
_ERRORS = {
    "smape": "CASE WHEN y = 0 AND g = 0 THEN 0 WHEN g < 0 THEN CASE WHEN y = 0 THEN 1 ELSE 0 END ELSE abs(g - y) / (g + y) END",
    "sse": "(y - g) * (y - g) / 1e6",
    "abs": "abs(y - g)",
}
for _how, _sql in _ERRORS.items():

    def _error(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        fit, held = split(revenue(spark, sf), [], 6)
        guess = models.forecast(models.train(fit, [], "linreg"), 6)
        met = held.join(guess.select("t", F.col("value").alias("g")), "t")
        y, g = F.col("y").cast("double"), F.col("g")
        value = {"smape": models.smape(y, g), "sse": models.sse(y, g) / 1e6, "abs": models.abs_error(y, g)}[how]
        return met.select("x", F.round(value, 6 if how == "smape" else 0).alias("error"))

    _error.__name__ = f"fc_error_{_how}"
    PLANS.query(f"{_HELD} SELECT x, round({_sql}, {6 if _how == 'smape' else 0}) AS error FROM e")(_error)


@PLANS.query()
def fc_holt_winters(spark: SparkSession, sf: str) -> DataFrame:
    s = revenue(spark, sf, ["o_orderstatus"])
    return _shown(models.forecast(models.train(s, ["o_orderstatus"], "holtwinters", period=12), 12), "o_orderstatus")


@PLANS.query()
def fc_arima(spark: SparkSession, sf: str) -> DataFrame:
    s = revenue(spark, sf, ["o_orderstatus"])
    found = models.with_interval(models.forecast(models.train(s, ["o_orderstatus"], "arima", ar=2, d=1, ma=1), 12), 95)
    return found.select("o_orderstatus", "h", F.col("t").cast("string").alias("t"), F.round("value", 2).alias("value"), F.round("half_width", 2).alias("half_width"))


@PLANS.query()
def fc_ets(spark: SparkSession, sf: str) -> DataFrame:
    s = series(load(spark, sf, "events"), "ts", F.sum("value"), ["event_type"], "day")
    return _shown(models.forecast(models.train(s, ["event_type"], "ets", period=7), 7, "day"), "event_type")


@PLANS.query()
def fc_auto_arima(spark: SparkSession, sf: str) -> DataFrame:
    s = revenue(spark, sf, ["o_orderstatus"])
    return _shown(models.forecast(models.train(s, ["o_orderstatus"], "auto_arima", period=12), 12), "o_orderstatus")


@PLANS.query(f"""WITH RECURSIVE {_S}, h AS (SELECT avg(y) FILTER (WHERE x <= 12) AS f, avg(y) FILTER (WHERE x > 12 AND x <= 24) AS g FROM r),
w(x, level, slope, season) AS (SELECT 12::BIGINT, f, (g - f) / 12, (SELECT list(y - f ORDER BY x) FROM r WHERE x <= 12) FROM h
UNION ALL SELECT r.x, 0.4 * (r.y - season[1]) + 0.6 * (level + slope), 0.2 * (0.4 * (r.y - season[1]) + 0.6 * (level + slope) - level) + 0.8 * slope,
list_append(season[2:], 0.3 * (r.y - (0.4 * (r.y - season[1]) + 0.6 * (level + slope))) + 0.7 * season[1]) FROM w JOIN r ON r.x = w.x + 1)
SELECT k AS h, round(level + k * slope + season[k], 2) AS value FROM (SELECT * FROM w ORDER BY x DESC LIMIT 1), range(1, 7) t(k)""")
def fc_holt_winters_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Holt-Winters with given weights."""
    found = models.forecast(models.train(revenue(spark, sf), [], "holtwinters", period=12, alpha=0.4, beta=0.2, gamma=0.3), 6)
    return found.select(F.col("h").cast("long").alias("h"), F.round("value", 2).alias("value"))
