"""Queries for scans, joins, aggregates, windows, order, sets and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import aggregates, joins, ordering, recursion, windows
from tidewater.plans.base import Plans
from tidewater.sources.tables import copy_from, copy_to, generate_series, load, scratch_path, values, with_children

PLANS = Plans()


@PLANS.query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue
FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1999-01-01'""")
def scan_filter_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").filter(F.col("l_quantity").between(5, 10) & F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@PLANS.query("SELECT a AS k, b AS name, a * 2 AS twice FROM (VALUES (1, 'one'), (2, 'two'), (NULL, 'none')) AS v(a, b)")
def values_scan(spark: SparkSession, sf: str) -> DataFrame:
    return values(spark, [(1, "one"), (2, "two"), (None, "none")], "a int, b string").select(F.col("a").alias("k"), F.col("b").alias("name"), (F.col("a") * 2).alias("twice"))


@PLANS.query("SELECT x AS up, NULL AS none FROM generate_series(1, 20, 3) AS s(x) UNION ALL SELECT x, NULL FROM generate_series(5, -5, -5) AS s(x)")
def generate_series_scan(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.range(1)
    up = one.select(F.explode(generate_series(1, 20, 3)).alias("up"))
    down = one.select(F.explode(generate_series(5, -5, -5)).alias("up"))
    empty = one.select(F.explode(generate_series(3, 1)).alias("up"))
    return up.union(down).union(empty).select("up", F.lit(None).cast("int").alias("none"))


@PLANS.query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "copy")
    copy_to(load(spark, sf, "nation"), path, delimiter=",", csv=True, header=True, force_quote=True)
    return copy_from(spark, path, "n_nationkey int, n_name string, n_regionkey int", delimiter=",", csv=True, header=True)


@PLANS.query("""SELECT s_name AS name, s_acctbal AS balance, 'supplier' AS tableoid FROM supplier
UNION ALL SELECT c_name, c_acctbal, 'customer' FROM customer""")
def inheritance_scan(spark: SparkSession, sf: str) -> DataFrame:
    parent = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    child = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    return with_children(parent, {"customer": child}, "supplier")


@PLANS.query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def _big_orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").filter("o_totalprice > 450000").select("o_orderkey", F.col("o_custkey").alias("custkey"))


def _some_customers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("custkey"), "c_name")


_BIG = "(SELECT o_orderkey, o_custkey AS custkey FROM orders WHERE o_totalprice > 450000) o"
_SOME = "(SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 5000) c"


@PLANS.query(f"SELECT custkey, o_orderkey, c_name FROM {_BIG} LEFT JOIN {_SOME} USING (custkey)")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return joins.using(_big_orders(spark, sf), _some_customers(spark, sf), ["custkey"], "left")


@PLANS.query(f"SELECT custkey, o_orderkey, c_name FROM {_BIG} RIGHT JOIN {_SOME} USING (custkey)")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    return joins.using(_big_orders(spark, sf), _some_customers(spark, sf), ["custkey"], "right")


@PLANS.query(f"SELECT custkey, o_orderkey, c_name FROM {_BIG} FULL JOIN {_SOME} USING (custkey)")
def join_full(spark: SparkSession, sf: str) -> DataFrame:
    return joins.using(_big_orders(spark, sf), _some_customers(spark, sf), ["custkey"], "full")


@PLANS.query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select("n_name").crossJoin(load(spark, sf, "region").select("r_name"))


@PLANS.query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey <= b.n_nationkey")
def join_theta(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") <= F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@PLANS.query("SELECT regionkey, n_name, r_name FROM (SELECT n_regionkey AS regionkey, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS regionkey, r_name FROM region)")
def join_natural(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.col("n_regionkey").alias("regionkey"), "n_name")
    return joins.natural(n, load(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name"))


@PLANS.query("""SELECT k, a, b, c FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 12) x
FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM nation WHERE n_nationkey % 2 = 0) y USING (k)
FULL JOIN (SELECT n_nationkey AS k, n_name AS c FROM nation WHERE n_nationkey % 3 = 0) z USING (k)""")
def join_multi_full(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").withColumn("k", F.col("n_nationkey"))
    x = n.filter("k < 12").select("k", F.col("n_name").alias("a"))
    y = n.filter("k % 2 = 0").select("k", F.col("n_regionkey").alias("b"))
    z = n.filter("k % 3 = 0").select("k", F.col("n_name").alias("c"))
    return joins.natural(joins.natural(x, y, "full"), z, "full")


@PLANS.query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@PLANS.query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@PLANS.query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
round(avg(l_discount), 6) AS avg_disc, min(l_shipdate)::DATE::VARCHAR AS first_ship, max(l_linenumber) AS max_line, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def agg_group(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_shipdate").cast("date").cast("string").alias("first_ship"), F.max("l_linenumber").alias("max_line"), F.count("*").alias("n"),
    )


@PLANS.query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS sum_keys, count(o_totalprice) AS n
FROM orders GROUP BY 1""")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.sum_distinct(F.col("o_custkey")).alias("sum_keys"), F.count("o_totalprice").alias("n"))


@PLANS.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14 AND max(o_totalprice) > 400000")
def agg_having(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return g.filter("n > 14 AND top > 400000").select("o_custkey", "n")


@PLANS.query("""SELECT o_orderstatus, round(var_pop(o_totalprice), 0) AS vp, round(var_samp(o_totalprice), 0) AS vs,
round(stddev_pop(o_totalprice), 4) AS sp, round(stddev_samp(o_totalprice), 4) AS ss FROM orders GROUP BY 1""")
def agg_stat(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_totalprice")
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.var_pop(x), 0).alias("vp"), F.round(F.var_samp(x), 0).alias("vs"), F.round(F.stddev_pop(x), 4).alias("sp"), F.round(F.stddev_samp(x), 4).alias("ss"))


@PLANS.query("""SELECT l_returnflag, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax,
round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp,
round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1""")
def agg_regr(spark: SparkSession, sf: str) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    found = {"n": (F.regr_count(y, x), None), "slope": (F.regr_slope(y, x), 4), "intercept": (F.regr_intercept(y, x), 3), "r2": (F.regr_r2(y, x), 6), "ax": (F.regr_avgx(y, x), 6), "ay": (F.regr_avgy(y, x), 4)}
    found |= {"sxx": (F.regr_sxx(y, x), 2), "cp": (F.covar_pop(y, x), 3), "cs": (F.covar_samp(y, x), 3), "r": (F.corr(y, x), 6)}
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(*((c if d is None else F.round(c, d)).alias(k) for k, (c, d) in found.items()))


@PLANS.query("""SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_totalprice > 499000) AS some_big,
bit_and(o_orderkey) AS band, bit_or(o_orderkey) AS bor FROM orders GROUP BY 1""")
def agg_bool_bit(spark: SparkSession, sf: str) -> DataFrame:
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.bool_and(x > 1000).alias("every_big"), F.bool_or(x > 499000).alias("some_big"), F.bit_and(k).alias("band"), F.bit_or(k).alias("bor"))


@PLANS.query("""SELECT n_regionkey, string_agg(CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE '-' END, ',' ORDER BY n_nationkey) AS names
FROM nation GROUP BY 1""")
def agg_array_agg(spark: SparkSession, sf: str) -> DataFrame:
    kept = aggregates.array_agg(F.expr("CASE WHEN n_nationkey % 3 > 0 THEN n_name END"), F.col("n_nationkey"))
    return load(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(kept, ",", "-").alias("names"))


@PLANS.query("""SELECT sum(o_totalprice) AS total, count(*) AS n, max(o_orderkey) AS top, array_agg(o_orderkey) IS NULL AS no_list FROM orders WHERE o_orderkey < 0""")
def agg_empty(spark: SparkSession, sf: str) -> DataFrame:
    none = load(spark, sf, "orders").filter("o_orderkey < 0")
    return none.agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.max("o_orderkey").alias("top"), aggregates.array_agg(F.col("o_orderkey")).isNull().alias("no_list"))


@PLANS.query("""SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS BIGINT) AS level, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@PLANS.query("""SELECT o_orderstatus, round(sqrt(sum(o_totalprice * o_totalprice)) / 1000, 3) AS norm FROM orders GROUP BY 1""")
def user_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders")
    norm = aggregates.merged_aggregate(rows, ["o_orderstatus"], F.col("o_totalprice"), "norm", F.lit(0.0), lambda a, x: a + x * x, lambda a, b: a + b, F.sqrt)
    return norm.select("o_orderstatus", F.round(F.col("norm") / 1000, 3).alias("norm"))


_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _by_customer() -> Window:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@PLANS.query(f"""SELECT o_orderkey, row_number() OVER ({_W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders""")
def win_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, sf, "orders").select("o_orderkey", *(f.cast("long").alias(k) for k, f in (("rn", F.row_number().over(_by_customer())), ("rk", F.rank().over(p)), ("dr", F.dense_rank().over(p)))))


@PLANS.query(f"""SELECT o_orderkey, round(percent_rank() OVER ({_W}), 6) AS pr, round(cume_dist() OVER ({_W}), 6) AS cd, ntile(3) OVER ({_W}) AS nt FROM orders""")
def win_cume(spark: SparkSession, sf: str) -> DataFrame:
    w = _by_customer()
    return load(spark, sf, "orders").select("o_orderkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.ntile(3).over(w).cast("long").alias("nt"))


@PLANS.query(f"""SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS before, lead(o_totalprice, 2, -1.0) OVER ({_W}) AS after,
first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W}) AS l, nth_value(o_orderkey, 2) OVER ({_W}) AS second FROM orders""")
def win_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    w, x, k = _by_customer(), F.col("o_totalprice"), F.col("o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", F.lag(x).over(w).alias("before"), F.lead(x, 2, -1.0).over(w).alias("after"), F.first(k).over(w).alias("f"), F.last(k).over(w).alias("l"), F.nth_value(k, 2).over(w).alias("second"))


_LINES = "SELECT *, CAST(l_linenumber AS BIGINT) AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS rn FROM lineitem"


@PLANS.query(f"""SELECT a.l_suppkey, a.rn, a.l_orderkey, CASE WHEN b.rn IS NULL THEN -1 ELSE b.l_orderkey END AS before FROM ({_LINES}) a
LEFT JOIN ({_LINES}) b ON a.l_suppkey = b.l_suppkey AND a.rn - a.line = b.rn""")
def win_lag_by_column(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    rows = load(spark, sf, "lineitem").withColumn("line", F.col("l_linenumber").cast("long")).withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("long"))
    return windows.lag(rows, ["l_suppkey"], ["rn"], "l_orderkey", "line", "before", F.lit(-1)).select("l_suppkey", "rn", "l_orderkey", "before")


@PLANS.query("""SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS total, CAST(sum(sum(cents)) OVER (ORDER BY o_custkey) AS BIGINT) AS running, CAST(sum(sum(cents)) OVER () AS BIGINT) AS everything
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY o_custkey""")
def win_agg_over_agg(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total"))
    return ordering.running_sum(g, ["o_custkey"], "total", "running", "everything")


@PLANS.query("""SELECT o_orderkey, count(*) OVER w AS peers, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
round(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS rest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def win_frames(spark: SparkSession, sf: str) -> DataFrame:
    w = _by_customer()
    peers = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, sf, "orders").select(
        "o_orderkey", F.count("*").over(peers).alias("peers"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.max("o_totalprice").over(w.rowsBetween(0, Window.unboundedFollowing)), 2).alias("rest"),
    )


@PLANS.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit_offset(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.limit_offset(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 20, 5)


@PLANS.query("""SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY q DESC NULLS FIRST, doc_id) AS place FROM
(SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)))""")
def sort_nulls(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id", "left")
    return ordering.numbered(rows, ["-q", "doc_id"], "place").select("doc_id", "place")


@PLANS.query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.distinct_on(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"])


@PLANS.query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.top_k(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"], 3).drop("o_totalprice")


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))


@PLANS.query(f"{_A} UNION {_B}")
def union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.union(b).distinct()


@PLANS.query(f"{_A} UNION ALL {_B}")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.union(b)


@PLANS.query(f"{_A} INTERSECT {_B}")
def intersect(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.intersect(b)


@PLANS.query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.intersectAll(b)


@PLANS.query(f"{_A} EXCEPT {_B}")
def except_distinct(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.subtract(b)


@PLANS.query(f"{_A} EXCEPT ALL {_B}")
def except_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)
    return a.exceptAll(b)


@PLANS.query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT a.o_custkey, round(a.t, 2) AS t FROM big a WHERE a.t > (SELECT avg(t) * 1.5 FROM big)")
def cte(spark: SparkSession, sf: str) -> DataFrame:
    big = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return joins.scalar(big, big.agg((F.avg("t") * 1.5).alias("bar"))).filter("t > bar").select("o_custkey", F.round("t", 2).alias("t"))


@PLANS.query("WITH RECURSIVE s(n, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 50) SELECT n, total FROM s")
def recursive_cte(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE s(n, total) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 50) SELECT n, total FROM s")


@PLANS.query("""WITH RECURSIVE e AS (SELECT n_nationkey AS f, (n_nationkey * 7 + 3) % 25 AS t FROM nation), r(k) AS (SELECT 1 UNION SELECT t FROM r JOIN e ON f = k) SELECT k FROM r""")
def recursive_union(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "nation").select(F.col("n_nationkey").alias("f"), F.expr("(n_nationkey * 7 + 3) % 25").alias("t"))
    return recursion.recursive_union(spark.range(1).select(F.lit(1).alias("k")), lambda last: last.join(e, F.col("f") == F.col("k")).select(F.col("t").alias("k")))


_TREE = "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS p FROM nation"


@PLANS.query(f"""WITH RECURSIVE t AS ({_TREE}), r AS (SELECT 0 AS k, CAST(NULL AS INTEGER) AS p, 0 AS level, '0' AS branch
UNION ALL SELECT t.k, t.p, r.level + 1, r.branch || '~' || t.k FROM r JOIN t ON t.p = r.k) SELECT k, p, level, branch FROM r""")
def connectby(spark: SparkSession, sf: str) -> DataFrame:
    tree = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.expr("CASE WHEN n_nationkey > 0 THEN cast((n_nationkey - 1) div 2 AS int) END").alias("p"))
    return recursion.connect_by(tree, "k", "p", 0)


@PLANS.query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    found = recursion.crosstab(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", F.count(F.lit(1)), ["F", "O", "P"])
    return found.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@PLANS.query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
def subq_scalar(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return joins.scalar(o, o.agg((1.9 * F.avg("o_totalprice")).alias("bar"))).filter("o_totalprice > bar").select("o_orderkey")


@PLANS.query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def subq_in(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").join(load(spark, sf, "lineitem").filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@PLANS.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subq_not_in(spark: SparkSession, sf: str) -> DataFrame:
    return joins.not_in(load(spark, sf, "documents").select("doc_id"), "doc_id", load(spark, sf, "labels").filter("quality = 1"), "doc_id")


@PLANS.query("SELECT o_orderkey FROM orders a WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)")
def subq_correlated(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.withColumn("top", F.max("o_totalprice").over(Window.partitionBy("o_custkey"))).filter("o_totalprice = top").select("o_orderkey")


@PLANS.query("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (40, 100) OR (o_orderstatus, o_orderpriority) IN (('P', '1-URGENT'), ('F', '5-LOW'))")
def row_comparison(spark: SparkSession, sf: str) -> DataFrame:
    first = joins.row("o_custkey", "o_orderkey") < F.struct(F.lit(40).cast("long").alias("f0"), F.lit(100).cast("long").alias("f1"))
    pairs = (("P", "1-URGENT"), ("F", "5-LOW"))
    among = [joins.row("o_orderstatus", "o_orderpriority") == F.struct(F.lit(a).alias("f0"), F.lit(b).alias("f1")) for a, b in pairs]
    return load(spark, sf, "orders").filter(first | among[0] | among[1]).select("o_orderkey")


@PLANS.query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE NULL END AS state, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS band,
coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS urgent, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, NULL, o_custkey) AS l, nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' AS d FROM orders""")
def case_coalesce_nullif(spark: SparkSession, sf: str) -> DataFrame:
    s, x, p = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    return load(spark, sf, "orders").select(
        "o_orderkey", F.when(s == "F", "done").when(s == "O", "open").alias("state"), F.when(x > 300000, 2).when(x > 100000, 1).otherwise(0).alias("band"),
        F.coalesce(F.nullif(p, F.lit("5-LOW")), F.lit("none")).alias("urgent"), F.greatest("o_orderkey", "o_custkey").alias("g"),
        F.least("o_orderkey", F.lit(None).cast("long"), "o_custkey").alias("l"), (~F.nullif(s, F.lit("P")).eqNullSafe(F.lit("F"))).alias("d"),
    )


@PLANS.query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = 7 GROUP BY 1")
def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_custkey = :k GROUP BY 1", args={"k": 7}, orders=load(spark, sf, "orders"))
