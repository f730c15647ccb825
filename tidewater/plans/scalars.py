"""Queries for scalar functions: text, numbers, dates, arrays, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import arrays, dates, fuzzy, numbers, rows, strings, textsearch
from tidewater.plans.base import Plans
from tidewater.sources.tables import load

PLANS = Plans()


@PLANS.query("""SELECT p_partkey, upper(p_name) AS up, lpad(p_brand, 10, '*') AS pad, replace(p_name, ' ', '_') AS rep, CAST(position('r' IN p_name) AS INTEGER) AS pos,
split_part(p_name, ' ', 2) AS second, substring(p_name, 2, 3) AS sub, CAST(length(p_name) AS INTEGER) AS len, trim(both 'se' FROM p_name) AS cut, md5(p_name) AS digest,
translate(p_name, 'aeiou', '12345') AS tr, repeat(left(p_name, 1), 3) AS rep3, reverse(p_name) AS rev FROM part""")
def str_basic(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return load(spark, sf, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lpad("p_brand", 10, "*").alias("pad"), F.replace(n, F.lit(" "), F.lit("_")).alias("rep"), F.position(F.lit("r"), n).alias("pos"),
        F.split_part(n, F.lit(" "), F.lit(2)).alias("second"), F.substring(n, 2, 3).alias("sub"), F.length(n).alias("len"), F.btrim(n, F.lit("se")).alias("cut"), F.md5(n).alias("digest"),
        F.translate(n, "aeiou", "12345").alias("tr"), F.repeat(F.left(n, F.lit(1)), 3).alias("rep3"), F.reverse(n).alias("rev"),
    )


@PLANS.query("""SELECT p_partkey, regexp_replace(p_name, '([aeiou])(.)', '\\2\\1') AS once, regexp_replace(p_name, '[aeiou]', '#', 'g') AS every,
array_to_string(regexp_extract_all(p_name, '[a-z]+'), '|') AS words, nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') AS num, regexp_matches(p_name, '^(red|small)') AS led FROM part""")
def str_regex(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return load(spark, sf, "part").select(
        "p_partkey", strings.regexp_replace(n, "([aeiou])(.)", r"\2\1").alias("once"), strings.regexp_replace(n, "[aeiou]", "#", "g").alias("every"),
        F.array_join(strings.regexp_matches(n, "[a-z]+"), "|").alias("words"), strings.substring_regex(F.col("p_brand"), "#([0-9]+)").alias("num"), n.rlike("^(red|small)").alias("led"),
    )


@PLANS.query("""SELECT p_partkey, p_name LIKE '%ring%' AS a, p_name NOT LIKE 's%' AS b, p_name ILIKE 'RED%' AS c, p_name LIKE '_e%' AS d, regexp_full_match(p_name, '(red|blue).*') AS e,
regexp_full_match(p_brand, 'Brand#[12][0-9]?') AS f FROM part""")
def str_like_similar(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return load(spark, sf, "part").select(
        "p_partkey", n.like("%ring%").alias("a"), (~n.like("s%")).alias("b"), n.ilike("RED%").alias("c"), n.like("_e%").alias("d"),
        strings.similar_to(n, "(red|blue)%").alias("e"), strings.similar_to(F.col("p_brand"), "Brand#[12][0-9]?").alias("f"),
    )


@PLANS.query("""SELECT c_custkey, '''' || replace(c_name, '''', '''''') || '''' AS lit, lower(to_hex(c_custkey)) AS hex, chr(CAST(945 + c_custkey % 24 AS INTEGER)) AS greek,
c_mktsegment || repeat(' ', 12 - length(c_mktsegment)) AS padded, lower(hex(encode(c_mktsegment))) AS bytes FROM customer""")
def str_codes(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    return load(spark, sf, "customer").select("c_custkey", strings.quote_literal(F.col("c_name")).alias("lit"), strings.to_hex(k).alias("hex"), strings.chr_(945 + k % 24).alias("greek"), strings.char_n(s, 12).alias("padded"), strings.encode(s, "hex").alias("bytes"))


@PLANS.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_partkey // 7 AS d, l_partkey % 7 AS m, -(l_orderkey) AS neg, abs(l_linenumber - 4) AS a,
round(ln(l_quantity), 9) AS ln, round(sqrt(l_quantity), 9) AS root, round(cbrt(l_quantity), 9) AS cube_root, round(exp(l_discount), 9) AS e,
round(power(l_quantity, 2), 4) AS p, sign(l_discount - 0.05) AS s FROM lineitem""")
def num_arith(spark: SparkSession, sf: str) -> DataFrame:
    k, q, n = F.col("l_partkey"), F.col("l_quantity"), F.col("l_linenumber")
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.int_div(k, F.lit(7)).alias("d"), (k % 7).alias("m"), (-F.col("l_orderkey")).alias("neg"), F.abs(n - 4).alias("a"),
        F.round(F.ln(q), 9).alias("ln"), F.round(F.sqrt(q), 9).alias("root"), F.round(F.cbrt(q), 9).alias("cube_root"), F.round(F.exp("l_discount"), 9).alias("e"),
        F.round(F.pow(q, 2), 4).alias("p"), F.signum(F.col("l_discount") - 0.05).alias("s"),
    )


@PLANS.query("""SELECT o_orderkey, CAST(round_even(o_orderkey / 2.0::DOUBLE, 0) AS BIGINT) AS half, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, trunc(o_totalprice) AS t,
CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice >= 400000 THEN 11 ELSE CAST(floor((o_totalprice - 100000) / 30000) AS BIGINT) + 1 END AS bucket FROM orders""")
def num_round(spark: SparkSession, sf: str) -> DataFrame:
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", numbers.to_int(k / 2.0, "long").alias("half"), F.floor(x).alias("f"), F.ceil(x).alias("c"), F.expr("cast(cast(o_totalprice AS bigint) AS double)").alias("t"), numbers.width_bucket(x, 100000, 400000, 10).alias("bucket"))


@PLANS.query("""SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 5 AS o, xor(p_partkey, 9) AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, right(bin(p_partkey + 65536), 16) AS b,
CAST(factorial(p_size % 10) AS BIGINT) AS fact FROM part""")
def bit_ops(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(
        "p_partkey", k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(5)).alias("o"), k.bitwiseXOR(F.lit(9)).alias("x"), F.shiftleft(k, 2).alias("l"), F.shiftright(k, 1).alias("r"),
        numbers.bits(k, 16).alias("b"), numbers.factorial(F.col("p_size") % 10).alias("fact"),
    )


_FIELDS = ("year", "month", "day", "hour", "minute", "quarter", "week", "dow", "isodow", "doy", "epoch", "decade", "century", "millennium")


@PLANS.query("SELECT event_id, " + ", ".join(f"round(CAST(date_part('{f}', ts) AS DOUBLE), 3) AS {f}_" for f in _FIELDS) + " FROM events")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", *(F.round(dates.part(f, F.col("ts")), 3).alias(f"{f}_") for f in _FIELDS))


_UNITS = ("hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")


_LONG = {"century": 100, "millennium": 1000}


def _first_of(unit: str) -> str:
    if unit not in _LONG:
        return f"strftime(date_trunc('{unit}', o_orderdate), '%Y-%m-%d %H') AS {unit}_"
    n = _LONG[unit]
    return f"(year(o_orderdate) - 1) // {n} * {n} + 1 || '-01-01 00' AS {unit}_"


@PLANS.query("SELECT o_orderkey, " + ", ".join(map(_first_of, _UNITS)) + " FROM orders")
def date_trunc(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", *(F.date_format(dates.trunc(u, F.col("o_orderdate")), "yyyy-MM-dd HH").alias(f"{u}_") for u in _UNITS))


@PLANS.query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_on, strftime(o_orderdate - INTERVAL 10 DAY + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS back,
date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%d.%m.%Y') AS text FROM orders""")
def date_interval(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return load(spark, sf, "orders").select(
        "o_orderkey", F.date_format(d + F.expr("INTERVAL 1 MONTH"), "yyyy-MM-dd").alias("month_on"), F.date_format(d - F.expr("INTERVAL 10 DAY") + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd HH:mm").alias("back"),
        dates.days_between(d.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"), dates.to_char(d, "DD.MM.YYYY").alias("text"),
    )


@PLANS.query("""SELECT o_orderkey, CASE WHEN a = b THEN TRUE WHEN a < TIMESTAMP '1997-01-01' THEN TIMESTAMP '1997-01-01' < b ELSE a < TIMESTAMP '1998-01-01' END AS met
FROM (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 45 DAY AS b FROM orders)""")
def date_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "1998-01-01"))
    return load(spark, sf, "orders").select("o_orderkey", dates.overlaps(d + F.expr("INTERVAL 45 DAY"), d, low, high).alias("met"))


_PRICES = "array_agg(DISTINCT CAST(l_linenumber AS INTEGER))"


@PLANS.query(f"""SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS distinct_lines, len(list(l_linenumber)) AS n,
list_contains(list(l_linenumber), 7) AS has, list_max(list(l_linenumber)) AS top, array_to_string(list_slice(list_sort(list_distinct(list(l_linenumber))), 2, 3), ',') AS part FROM lineitem GROUP BY 1""")
def arr_ops(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_linenumber").alias("a"))
    a = F.col("a")
    unique = F.array_sort(F.array_distinct(a))
    return g.select("l_suppkey", arrays.to_string(unique.cast("array<string>"), ",").alias("distinct_lines"), F.size(a).cast("long").alias("n"), F.array_contains(a, 7).alias("has"), F.array_max(a).alias("top"), arrays.to_string(arrays.slice_(unique, 2, 3).cast("array<string>"), ",").alias("part"))


@PLANS.query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i,
list_has_all(a, b) AS contains, list_has_any(a, b) AS overlaps FROM (SELECT p_partkey, [p_size % 5, p_size % 3, 1] AS a, [p_size % 2, 1] AS b FROM part)""")
def arr_setops(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.expr("array(p_size % 5, p_size % 3, 1)"), F.expr("array(p_size % 2, 1)")
    text = lambda c: arrays.to_string(F.array_sort(c).cast("array<string>"), ",")
    return load(spark, sf, "part").select("p_partkey", text(F.array_union(a, b)).alias("u"), text(F.array_intersect(a, b)).alias("i"), arrays.contains(a, b).alias("contains"), arrays.overlap(a, b).alias("overlaps"))


@PLANS.query("SELECT vec_id, i - 1 AS place, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def unnest(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


@PLANS.query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS t, json_extract_string(json_merge_patch(json_merge_patch(props, json_object('t', event_type, 'a', 'a')), '{"a":"b"}'), '$.a') AS a_wins, NOT event_type = 'click' AS kept FROM events""")
def map_ops(spark: SparkSession, sf: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    m = arrays.hs_concat(m, F.create_map(F.lit("t"), F.col("event_type"), F.lit("a"), F.lit("a")))
    m = arrays.hs_concat(m, F.create_map(F.lit("a"), F.lit("b")))
    left = arrays.hs_delete(m, F.lit("k"))
    return load(spark, sf, "events").select("event_id", F.element_at(m, "k").cast("long").alias("k"), F.element_at(m, "t").alias("t"), F.element_at(left, "a").alias("a_wins"), (~arrays.hs_contains(left, F.create_map(F.lit("t"), F.lit("click")))).alias("kept"))


@PLANS.query("""SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 6) AS d
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def cube_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    probe = e.filter("vec_id = 0").select(F.col("embedding").alias("probe")).limit(1)
    return e.crossJoin(F.broadcast(probe)).select("vec_id", F.round(arrays.cube_distance(F.col("embedding"), F.col("probe")), 6).alias("d"))


@PLANS.query("SELECT c_custkey, levenshtein(c_mktsegment, 'MACHINERY') AS d, levenshtein(c_mktsegment, 'MACHINERY') AS costs FROM customer")
def fuzzy_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("c_mktsegment")
    return load(spark, sf, "customer").select("c_custkey", fuzzy.levenshtein(s, F.lit("MACHINERY")).cast("long").alias("d"), fuzzy.levenshtein_with_costs(s, F.lit("MACHINERY"), 1, 1, 1).cast("long").alias("costs"))


_GRAMS = "list_distinct(flatten(list_transform(string_split({}, ' '), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"


@PLANS.query(f"""SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS sim
FROM (SELECT p_partkey, {_GRAMS.format("p_name")} AS a, {_GRAMS.format("'red widget'")} AS b FROM part)""")
def trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.round(fuzzy.similarity(F.col("p_name"), F.lit("red widget")), 6).alias("sim"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@PLANS.query(f"""SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE (list_contains(w, 'idiot') OR list_contains(w, 'clown')) AND NOT list_contains(w, 'the')
OR len(list_filter(w, lambda x: starts_with(x, 'disgust'))) > 0""")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").filter(textsearch.matches(textsearch.lexemes(F.col("text")), "(idiot | clown) & !the | disgust:*")).select("doc_id")


@PLANS.query(f"""SELECT word, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY 1""")
def fts_stat(spark: SparkSession, sf: str) -> DataFrame:
    return textsearch.ts_stat(load(spark, sf, "documents"))


@PLANS.query(f"""SELECT doc_id, round((coalesce(list_sum(list_transform(range(1, a + 1), lambda k: 0.1 / (k * k))), 0) + coalesce(list_sum(list_transform(range(1, b + 1), lambda k: 0.1 / (k * k))), 0)) / 1.64493406685 / 2, 6) AS rank
FROM (SELECT doc_id, len(list_filter(w, lambda x: x = 'idiot')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM (SELECT doc_id, {_WORDS} AS w FROM documents))""")
def fts_rank(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.round(textsearch.ts_rank(F.col("text"), ["idiot", "the"]), 6).alias("rank"))


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@PLANS.query("SELECT o_orderkey, CAST(list_position(['" + "','".join(_ORDER) + "'], o_orderpriority) AS BIGINT) AS place FROM orders WHERE list_position(['" + "','".join(_ORDER) + "'], o_orderpriority) >= 3")
def enum_order(spark: SparkSession, sf: str) -> DataFrame:
    place = rows.enum_order(F.col("o_orderpriority"), _ORDER)
    return load(spark, sf, "orders").withColumn("place", place).filter("place >= 3").select("o_orderkey", "place")


@PLANS.query("""SELECT n_nationkey, '<nation key="' || n_nationkey || '"><n_name>' || n_name || '</n_name></nation>' AS xml, n_name AS name FROM nation""")
def xml_build(spark: SparkSession, sf: str) -> DataFrame:
    xml = rows.xmlelement("nation", {"key": F.col("n_nationkey")}, rows.xmlforest(n_name=F.col("n_name")))
    return load(spark, sf, "nation").withColumn("xml", xml).select("n_nationkey", "xml", F.xpath_string("xml", F.lit("/nation/n_name")).alias("name"))


@PLANS.query("""SELECT c_custkey, '10.' || (c_nationkey % 4) || '.0.0/16' AS net, '10.' || (c_nationkey % 4) || '.255.255' AS last, c_nationkey % 4 = 1 AS inside FROM customer""")
def inet_ops(spark: SparkSession, sf: str) -> DataFrame:
    a = F.format_string("10.%d.%d.%d/16", F.col("c_nationkey") % 4, F.col("c_custkey") % 250, F.col("c_custkey") % 7)
    return load(spark, sf, "customer").select("c_custkey", rows.network(a).alias("net"), rows.broadcast_address(a).alias("last"), rows.within(a, F.lit("10.1.0.0/12")).alias("in12"), rows.within(a, F.lit("10.1.0.0/15")).alias("in15")).select(
        "c_custkey", "net", "last", (F.col("in15") & F.col("net").startswith("10.1.")).alias("inside")
    )


@PLANS.query("""SELECT p_partkey, CAST(len(string_split(p_type || '.' || replace(p_name, ' ', '_') || '.' || replace(p_brand, '#', ''), '.')) AS INTEGER) AS levels, p_type AS top, (p_type = 'ECONOMY' AND p_name LIKE 'red%') AS hit FROM part""")
def path_ops(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws(".", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    return load(spark, sf, "part").select("p_partkey", arrays.nlevel(path).alias("levels"), arrays.subpath(path, 0, 1).alias("top"), arrays.lquery(path, "ECONOMY.red*.*{1}").alias("hit"))
