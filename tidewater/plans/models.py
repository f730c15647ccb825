"""Queries for the model catalog, the model graph, upkeep and approximate scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.approx import segment
from tidewater.forecast import catalog, graph, models
from tidewater.forecast.series import series
from tidewater.plans.base import Plans
from tidewater.plans.forecasts import revenue
from tidewater.sources.tables import load, scratch_path
from tidewater.streaming import maintain

PLANS = Plans()

_DIMS = ["flag", "status"]


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_shipdate", "l_quantity")
    return graph.nodes(rows, _DIMS, F.date_trunc("quarter", F.col("l_shipdate")).cast("date"), F.col("l_quantity"))


_CUBE = """c AS (SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, t, sum(l_quantity) AS y, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS level
FROM (SELECT *, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS t FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, t), (l_returnflag, t), (l_linestatus, t), (t)))"""


@PLANS.query(f"WITH {_CUBE} SELECT flag, status, CAST(level AS BIGINT) AS level, CAST(t AS VARCHAR) AS t, y, row_number() OVER (PARTITION BY flag, status ORDER BY t) AS x FROM c")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).select("flag", "status", F.col("level").cast("long").alias("level"), F.col("t").cast("string").alias("t"), "y", "x")


@PLANS.query(f"WITH {_CUBE} SELECT flag, status, round(sum(y) / (SELECT sum(y) FROM c WHERE level = 3), 9) AS share FROM c WHERE level = 0 GROUP BY 1, 2")
def graph_disagg_keys(spark: SparkSession, sf: str) -> DataFrame:
    return graph.disaggregation_keys(_graph(spark, sf), _DIMS).select(*_DIMS, F.round("share", 9).alias("share"))


@PLANS.query(f"""WITH {_CUBE} SELECT flag, status, level, count(*) AS n FROM c WHERE level = 0 GROUP BY 1, 2, 3
UNION ALL SELECT flag, status, level, count(*) FROM c WHERE level = 3 GROUP BY 1, 2, 3""")
def graph_fill(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    owned = graph.fill(g, _DIMS, "bottomup").union(graph.fill(g, _DIMS, "topdown"))
    return owned.groupBy(*_DIMS, "level").agg(F.count("*").alias("n"))


@PLANS.query()
def graph_greedy(spark: SparkSession, sf: str) -> DataFrame:
    errors = graph.rolling_errors(_graph(spark, sf), _DIMS, held=4)
    matrix = errors.toPandas()  # nodes by ancestors: bounded by the dimensions, not the data
    chosen, _ = graph.greedy(matrix, _DIMS)
    return graph.assign(spark.createDataFrame(matrix), _DIMS, chosen).withColumn("error", F.round("error", 6))


@PLANS.query("""WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(CAST(round(o_totalprice) AS BIGINT)) AS y FROM orders GROUP BY 1)
SELECT 'orders_revenue_medium' AS name, count(*) AS n, round(avg(y), 2) AS value FROM s""")
def model_catalog(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "models")
    where = [("o_orderkey", ">=", 0)]
    for algorithm in ("medium", "linreg"):
        catalog.store(catalog.describe(models.train(revenue(spark, sf), [], algorithm), "orders", "o_orderdate", "revenue", "month", "sum", where), path)
    found = catalog.match(catalog.restore(spark, path), "orders", "o_orderdate", "revenue", "month", "sum", where, "medium")
    one = models.forecast(found.withColumn("n_rows", F.col("n")), 1)
    return one.select("name", F.col("n_rows").alias("n"), F.round("value", 2).alias("value"))


@PLANS.query(f"WITH {_CUBE} SELECT flag, status, CAST(count(*) AS BIGINT) AS n FROM c WHERE flag IN ('A', 'R') AND status = '*' GROUP BY 1, 2")
def graph_path_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes for flag IN ('A', 'R') over any status, from a stored graph."""
    path = scratch_path(spark, "graph")
    g = _graph(spark, sf)
    graph.store(g, models.train(g, [*_DIMS, "level"], "medium"), path)
    nodes, _ = graph.restore(spark, path)
    wanted = graph.targets(nodes, _DIMS, {"flag": ["A", "R"]})
    return nodes.join(wanted, [*_DIMS, "level"]).groupBy(*_DIMS).agg(F.count("*").alias("n"))


@PLANS.query(f"""WITH {_CUBE}, k AS (SELECT flag, status, sum(y) / (SELECT sum(y) FROM c WHERE level = 3) AS share FROM c WHERE level = 0 GROUP BY 1, 2), m AS (SELECT avg(y) AS mean FROM c WHERE level = 3)
SELECT flag, status, round(mean * share, 4) AS value FROM k, m UNION ALL SELECT flag, '*', round(mean * sum(share), 4) FROM k, m GROUP BY flag, mean""")
def graph_schemes(spark: SparkSession, sf: str) -> DataFrame:
    """The node of all's forecast by fixed keys down to the finest nodes, and
    these up to the nodes of a flag."""
    g = _graph(spark, sf)
    top = models.forecast(models.train(graph.fill(g, _DIMS, "topdown"), _DIMS, "medium"), 1, "quarter").select(*_DIMS, "h", "value")
    keys = graph.disaggregation_keys(g, _DIMS).select(*_DIMS, *(F.lit(graph.ALL).alias(f"s_{d}") for d in _DIMS), F.col("share").alias("key"))
    fine = graph.down(top, keys, _DIMS).select(*_DIMS, "h", "value")
    above = fine.select(*_DIMS, F.col("flag").alias("s_flag"), F.lit(graph.ALL).alias("s_status"), F.lit(1.0).alias("key"))
    both = fine.union(graph.upward(fine, above, _DIMS, ["h"]).select(*_DIMS, "h", "value"))
    return both.select(*_DIMS, F.round("value", 4).alias("value"))


@PLANS.query("SELECT 'Forecast  (algorithm=medium steps=6 n=' || count(DISTINCT date_trunc('month', o_orderdate)) || ' after=' || strftime(date_trunc('month', max(o_orderdate)), '%Y-%m-%d') || ')  Model: count, sum' AS plan FROM orders")
def fc_explain(spark: SparkSession, sf: str) -> DataFrame:
    return models.explain(models.train(revenue(spark, sf), [], "medium"), 6)


@PLANS.query()
def maintain_ar_on_demand(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.replay_ar(load(spark, sf, "events"), "event_type", "ts", "event_id", "value")


@PLANS.query()
def approx_minimax(spark: SparkSession, sf: str) -> DataFrame:
    return segment.minimax(_hourly(spark, sf), ["event_type"], 16).withColumns({c: F.round(c, 4) for c in ("slope", "intercept", "error")})


@PLANS.query()
def approx_seasons(spark: SparkSession, sf: str) -> DataFrame:
    return segment.seasons(_hourly(spark, sf), ["event_type"], [24, 168])


@PLANS.query()
def maintain_simple_reest(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.replay(load(spark, sf, "events"), "user_id", "ts", "event_id", "value")


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return series(load(spark, sf, "events"), "ts", F.sum("value"), ["event_type"], "hour")


_LINE = """h AS (SELECT event_type, date_trunc('hour', ts) AS t, sum(value) AS y FROM events GROUP BY 1, 2), r AS (SELECT event_type, y, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM h),
l AS (SELECT *, CAST(floor(p * 16 / n) AS BIGINT) AS seg FROM r), f AS (SELECT event_type, seg, coalesce(regr_slope(y, p), 0) AS b, coalesce(regr_intercept(y, p), avg(y)) AS a FROM l GROUP BY 1, 2)"""


@PLANS.query(f"WITH {_LINE} SELECT event_type, p, round(a + b * p, 4) AS value, 2 AS layer FROM l JOIN f USING (event_type, seg)")
def approx_scan_layers(spark: SparkSession, sf: str) -> DataFrame:
    nodes = segment.build(_hourly(spark, sf), ["event_type"], layers=3)
    return segment.scan(nodes, ["event_type"], layer=2).withColumn("value", F.round("value", 4))


_SEASONED = """s0 AS (SELECT event_type, p, n, y, avg(y - a - b * p) OVER (PARTITION BY event_type, p % 24) AS s FROM (SELECT *, regr_slope(y, p) OVER w AS b, regr_intercept(y, p) OVER w AS a FROM r WINDOW w AS (PARTITION BY event_type)))"""
_TREE = f"""{_LINE.split(", l AS")[0].split(chr(10) + "l AS")[0].rstrip(",")}, {_SEASONED}, e0 AS (SELECT event_type, p, y - s AS v, s, layer, CAST(floor(p * pow(4, layer) / n) AS BIGINT) AS seg FROM s0, range(0, 4) g(layer)),
f0 AS (SELECT event_type, layer, seg, coalesce(regr_slope(v, p), 0) AS b, coalesce(regr_intercept(v, p), avg(v)) AS a FROM e0 GROUP BY 1, 2, 3),
q0 AS (SELECT event_type, layer, seg, quantile_disc(abs(v - a - b * p), 0.9) AS err FROM e0 JOIN f0 USING (event_type, layer, seg) GROUP BY 1, 2, 3),
x0 AS (SELECT event_type, p, layer, a + b * p + s AS value, err FROM e0 JOIN f0 USING (event_type, layer, seg) JOIN q0 USING (event_type, layer, seg))"""


@PLANS.query(f"WITH {_TREE} SELECT event_type, p, round(arg_min(value, CASE WHEN err < 50 THEN layer ELSE 4 - layer / 4.0 END) + 3.3e-7, 4) AS value, arg_min(layer, CASE WHEN err < 50 THEN layer ELSE 4 - layer / 4.0 END) AS layer FROM x0 GROUP BY 1, 2")
def approx_scan_error(spark: SparkSession, sf: str) -> DataFrame:
    nodes = segment.build(_hourly(spark, sf), ["event_type"], layers=4, frequency=24)
    return segment.scan(nodes, ["event_type"], error=50.0, frequency=24).withColumn("value", F.round(F.col("value") + 3.3e-7, 4))  # means of a few cents often lie half way between two digits


@PLANS.query(f"WITH {_TREE} SELECT event_type, p // 24 AS run, CAST(trunc(sum(value)) AS BIGINT) AS value FROM x0 WHERE layer = 1 GROUP BY 1, 2")
def approx_group_scan(spark: SparkSession, sf: str) -> DataFrame:
    nodes = segment.build(_hourly(spark, sf), ["event_type"], layers=3, frequency=24)
    return segment.grouped(segment.scan(nodes, ["event_type"], layer=1, frequency=24), ["event_type"], 24, "s")
