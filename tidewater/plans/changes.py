"""Queries for table changes, subqueries, set operations and more aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import aggregates, changes, joins, ordering, recursion
from tidewater.plans.base import Plans
from tidewater.sources.tables import copy_from, copy_to, load, scratch_path, with_children

PLANS = Plans()


@PLANS.query("""SELECT n_nationkey, n_name, n_regionkey, FALSE AS fresh FROM nation UNION ALL SELECT 100 + r_regionkey, upper(r_name), r_regionkey, FALSE FROM region
UNION ALL SELECT 100 + r_regionkey, upper(r_name), r_regionkey, TRUE FROM region""")
def dml_insert_returning(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_regionkey").alias("n_regionkey"), F.upper("r_name").alias("n_name"))
    table, new = changes.insert(load(spark, sf, "nation"), rows)
    return table.withColumn("fresh", F.lit(False)).union(new.withColumn("fresh", F.lit(True)))


@PLANS.query("""SELECT r_regionkey + 10 AS n_nationkey, r_name AS n_name, 7 AS n_regionkey FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def dml_insert_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "region").select((F.col("r_regionkey") + 10).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return changes.insert(load(spark, sf, "nation"), rows, {"n_regionkey": F.lit(7)})[0]


@PLANS.query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer""")
def dml_update(spark: SparkSession, sf: str) -> DataFrame:
    table = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return changes.update(table, {"c_acctbal": F.lit(0.0), "c_nationkey": F.col("c_nationkey") + 1}, F.col("c_acctbal") < 0)[0]


@PLANS.query("""SELECT o_orderkey, o_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B:' || c_name ELSE o_orderstatus END AS o_orderstatus, coalesce(c_mktsegment = 'BUILDING', FALSE) AS changed
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def dml_update_from(spark: SparkSession, sf: str) -> DataFrame:
    table = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumn("changed", F.lit(False))
    source = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    new = {"o_orderstatus": F.concat(F.lit("B:"), F.col("c_name")), "changed": F.lit(True)}
    return changes.update_from(table, source, ["o_custkey"], new, F.col("c_mktsegment") == "BUILDING")[0]


@PLANS.query("""SELECT o_orderkey, o_orderpriority, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS gone FROM orders""")
def dml_delete_using(spark: SparkSession, sf: str) -> DataFrame:
    poor = load(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    kept, gone = changes.delete_using(load(spark, sf, "orders"), poor, ["o_custkey"])
    return kept.select("o_orderkey", "o_orderpriority", F.lit(False).alias("gone")).union(gone.select("o_orderkey", "o_orderpriority", F.lit(True)))


@PLANS.query("""SELECT s_suppkey, s_name FROM supplier WHERE NOT s_acctbal < 3000 UNION ALL SELECT -1, 'truncated: ' || 0""")
def dml_delete_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Deletes, stores the rest as the table's next version, reads that back,
    and counts a truncated copy."""
    path = scratch_path(spark, "table")
    table = load(spark, sf, "supplier")
    changes.replace_table(table, path)
    changes.replace_table(changes.delete(changes.current_table(spark, path), F.col("s_acctbal") < 3000)[0], path)
    none = changes.truncate(table).agg(F.lit(-1).cast("bigint").alias("s_suppkey"), F.concat(F.lit("truncated: "), F.count("*")).alias("s_name"))
    return changes.current_table(spark, path).select("s_suppkey", "s_name").union(none)


@PLANS.query("SELECT c_mktsegment AS segment, count(*) AS n, sum(c_custkey) AS keys FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def select_into(spark: SparkSession, sf: str) -> DataFrame:
    """SELECT INTO: the result is stored as a table and read from there."""
    path = scratch_path(spark, "into")
    changes.replace_table(load(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment"), path)
    return changes.current_table(spark, path).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@PLANS.query("SELECT p_partkey, nullif(p_name, 'red widget') AS p_name, p_size FROM part")
def copy_text_nulls(spark: SparkSession, sf: str) -> DataFrame:
    r"""COPY in text format: another delimiter, ``\N`` for null."""
    path = scratch_path(spark, "copy")
    rows = load(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_name"), F.lit("red widget")).alias("p_name"), "p_size")
    copy_to(rows, path, delimiter="|", null="\\N")
    return copy_from(spark, path, "p_partkey bigint, p_name string, p_size int", delimiter="|", null="\\N")


_BAL = "(SELECT s_acctbal FROM supplier)"


@PLANS.query(f"""SELECT c_custkey, c_acctbal > ANY {_BAL} AS over_any, c_acctbal > ALL {_BAL} AS over_all, c_acctbal <= ALL {_BAL} AS under_all,
c_nationkey = ANY (SELECT s_nationkey FROM supplier) AS same, c_nationkey <> ALL (SELECT s_nationkey FROM supplier) AS none_same FROM customer""")
def subq_any_all(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    c = joins.compare_any(c, "c_acctbal", ">", s, "s_acctbal", "over_any")
    c = joins.compare_all(c, "c_acctbal", ">", s, "s_acctbal", "over_all")
    c = joins.compare_all(c, "c_acctbal", "<=", s, "s_acctbal", "under_all")
    c = joins.compare_any(c, "c_nationkey", "=", s, "s_nationkey", "same")
    c = joins.compare_all(c, "c_nationkey", "<>", s, "s_nationkey", "none_same")
    return c.drop("c_acctbal", "c_nationkey")


@PLANS.query("""SELECT n_nationkey, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_acctbal, s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation""")
def subq_array(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    found = joins.array_of(load(spark, sf, "nation").select("n_nationkey"), s, ["n_nationkey"], F.col("s_name"), ["s_acctbal", "s_name"], "a")
    return found.select("n_nationkey", F.array_join("a", ",").alias("suppliers"))


@PLANS.query("""SELECT o_orderkey FROM orders WHERE row(o_custkey, o_orderdate) = (SELECT row(o_custkey, o_orderdate) FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))
OR (o_custkey, o_orderstatus) IN (SELECT (c_custkey, 'F') FROM customer WHERE c_acctbal > 9000)""")
def subq_row(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    first = o.select(F.struct("o_orderkey", "o_custkey", "o_orderdate").alias("f")).agg(F.min("f").alias("f")).select(joins.row("f.o_custkey", "f.o_orderdate").alias("wanted"))
    same = joins.scalar(o, first).filter(joins.row("o_custkey", "o_orderdate") == F.col("wanted")).select("o_orderkey")
    rich = load(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return same.union(o.join(rich, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey")).distinct()


@PLANS.query("""(SELECT c_nationkey AS k, CAST(1 AS DOUBLE) AS v FROM customer UNION SELECT s_nationkey, 1.5::DOUBLE FROM supplier) INTERSECT (SELECT n_nationkey, 1.0::DOUBLE FROM nation
EXCEPT SELECT n_nationkey, 1.0::DOUBLE FROM nation WHERE n_regionkey = 2) UNION ALL SELECT r_regionkey, 0.5::DOUBLE FROM region""")
def set_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Nested set operations; integers and decimals meet as doubles."""
    one = lambda t, k, v: load(spark, sf, t).select(F.col(k).alias("k"), F.lit(v).cast("double").alias("v"))
    left = one("customer", "c_nationkey", 1).union(one("supplier", "s_nationkey", 1.5)).distinct()
    some = load(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("k"), F.lit(1.0).alias("v"))
    return left.intersect(one("nation", "n_nationkey", 1).subtract(some)).union(one("region", "r_regionkey", 0.5))


@PLANS.query("""WITH a AS (SELECT s_name AS name, s_nationkey AS n, 'supplier' AS t FROM supplier UNION ALL SELECT c_name, c_nationkey, 'customer' FROM customer)
SELECT x.t AS left_table, y.t AS right_table, count(*) AS pairs FROM a x JOIN (SELECT * FROM a WHERE t = 'supplier') y ON x.n = y.n GROUP BY 1, 2""")
def join_inherited_self(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of tables joined with its own root.  Rows of a key are counted
    first, so the pairs are products of counts."""
    parent = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    child = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    whole = with_children(parent, {"customer": child}, "supplier")
    counts = lambda rows, name: rows.groupBy("n", F.col("tableoid").alias(f"{name}_table")).agg(F.count("*").alias(name))
    both = counts(whole, "left").join(counts(whole.filter("tableoid = 'supplier'"), "right"), "n")
    return both.groupBy("left_table", "right_table").agg(F.sum(F.col("left") * F.col("right")).alias("pairs"))


@PLANS.query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def join_unique_inner(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").filter("s_acctbal > 0").withColumnRenamed("s_nationkey", "c_nationkey")
    return joins.unique_inner(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), s, ["c_nationkey"])


@PLANS.query("""SELECT l_returnflag, round(regr_syy(l_extendedprice, l_quantity) / 1e6, 3) AS syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e6, 4) AS sxy FROM lineitem GROUP BY 1""")
def agg_regr_sums(spark: SparkSession, sf: str) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    sxy = F.covar_pop(y, x) * F.count("*")
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_syy(y, x) / 1e6, 3).alias("syy"), F.round(sxy / 1e6, 4).alias("sxy"))


@PLANS.query("""SELECT o_orderstatus, CAST(round(avg(o_custkey), 6) AS DOUBLE) AS mean, min(o_orderpriority) AS low, max(o_orderpriority) AS high, strftime(min(o_orderdate), '%Y-%m-%d') AS first,
strftime(max(o_orderdate), '%Y-%m-%d') AS last, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS exact, CAST(sum(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS days FROM orders GROUP BY 1""")
def agg_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of integers, extremes of texts and dates, sums of decimals and intervals."""
    d = F.col("o_orderdate")
    since = F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date"))
    spans = aggregates.interval_sum(F.make_dt_interval(days=since))
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.round(aggregates.exact_avg(F.col("o_custkey")), 6).cast("double").alias("mean"), F.min("o_orderpriority").alias("low"), F.max("o_orderpriority").alias("high"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("first"), F.date_format(F.max(d), "yyyy-MM-dd").alias("last"),
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("exact"), spans["days"].alias("days"),
    )


@PLANS.query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders")
def agg_min_max_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Answered from the files' statistics where they have them."""
    return load(spark, sf, "orders").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


@PLANS.query("""SELECT r_regionkey, (SELECT string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names,
(SELECT string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS keys FROM region""")
def agg_xml_and_ints(spark: SparkSession, sf: str) -> DataFrame:
    """xmlagg in order, and integers gathered into an array."""
    element = F.concat(F.lit("<n>"), F.col("n_name"), F.lit("</n>"))
    g = load(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey"))
    return g.agg(aggregates.xmlagg(element, F.col("n_name")).alias("names"), F.array_join(aggregates.array_agg(F.col("n_nationkey"), F.col("n_nationkey")).cast("array<string>"), ",").alias("keys"))


@PLANS.query("""SELECT l_orderkey, max(CASE WHEN r = 1 THEN l_quantity END) AS q1, max(CASE WHEN r = 2 THEN l_quantity END) AS q2, max(CASE WHEN r = 3 THEN l_quantity END) AS q3
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem) GROUP BY 1""")
def crosstab_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """crosstab(sql, n): the first n values of each row, whatever their category."""
    g = ordering.top_k(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_quantity"], 3)
    lists = g.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))
    return lists.select("l_orderkey", *(F.get("a", F.lit(k))["l_quantity"].alias(f"q{k + 1}") for k in range(3)))


@PLANS.query("""SELECT n_nationkey AS node, 1 + (n_nationkey % 3 = 0)::BIGINT AS reports FROM nation WHERE n_nationkey < 0 UNION ALL
SELECT k, CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END FROM (SELECT n_nationkey AS k FROM nation)""")
def cycle_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Walks edges k -> next within blocks of five and reports where a path
    comes back to a node it holds, instead of failing."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.select(F.col("k").alias("parent"), F.when(F.col("k") % 5 == 4, F.col("k") - 4).otherwise(F.col("k") + 1).alias("child"))
    walk = recursion.paths(edges, n.filter("k % 5 = 0").select(F.col("k").alias("node")))
    back = walk.filter("cycle").groupBy(F.element_at("path", -2).alias("node")).agg(F.count("*").alias("reports"))
    return n.select(F.col("k").alias("node")).join(back, "node", "left").select("node", F.coalesce("reports", F.lit(0)).cast("bigint").alias("reports"))


@PLANS.query(None)
def normal_rand(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.normal_rand(spark, 1000, 5.0, 3.0, seed=7)


@PLANS.query("SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY length(o_orderpriority) DESC, o_totalprice % 1000 DESC, o_orderkey LIMIT 50)")
def sort_by_expression(spark: SparkSession, sf: str) -> DataFrame:
    """ORDER BY expressions, and USING > as descending order."""
    rows = load(spark, sf, "orders").select("o_orderkey", F.length("o_orderpriority").alias("a"), (F.col("o_totalprice") % 1000).alias("b"))
    return ordering.limit_offset(rows, ["-a", "-b", "o_orderkey"], 50, 0).select("o_orderkey")
