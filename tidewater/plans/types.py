"""Queries for functions of single types: texts, times, numbers, containers,
search vectors, addresses, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import arrays, dates, fuzzy, geometry, numbers, rows, strings, textsearch
from tidewater.plans.base import Plans
from tidewater.sources.tables import load

PLANS = Plans()


@PLANS.query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS caps, ltrim(p_name, 'rs') AS l, rtrim(p_name, 'te') AS r,
CAST(ascii(p_name) AS INTEGER) AS code, p_name LIKE '%d w%' AS plain, replace(p_brand, '#', '_') LIKE '%d$_1%' ESCAPE '$' AS escaped,
array_to_string(string_split_regex(p_name, '[ aeiou]+'), '|') AS cut, regexp_extract(p_brand, '([a-z]+)#([0-9])', 1) || '/' || regexp_extract(p_brand, '([a-z]+)#([0-9])', 2) AS groups,
regexp_replace(p_name, 'd|g|l', '<>') AS first_hit FROM part""")
def str_more(spark: SparkSession, sf: str) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    return load(spark, sf, "part").select(
        "p_partkey", strings.initcap(n).alias("caps"), F.ltrim(n, F.lit("rs")).alias("l"), F.rtrim(n, F.lit("te")).alias("r"), F.ascii(n).alias("code"), n.like("%d w%").alias("plain"),
        F.like(F.replace(b, F.lit("#"), F.lit("_")), F.lit("%d$_1%"), F.lit("$")).alias("escaped"), F.array_join(F.split(n, "[ aeiou]+"), "|").alias("cut"),
        F.array_join(F.get(strings.regexp_match_groups(b, "([a-z]+)#([0-9])"), F.lit(0)), "/").alias("groups"), strings.regexp_replace(n, "d|g|l", "<>").alias("first_hit"),
    )


@PLANS.query("SELECT doc_id, strip_accents(text) AS plain, lower(text) = lower(upper(text)) AS same FROM documents WHERE text NOT LIKE '%ß%'")
def str_to_ascii(spark: SparkSession, sf: str) -> DataFrame:
    """Marks go from letters; texts are equal when case is ignored."""
    t = F.col("text")
    return load(spark, sf, "documents").filter(~F.contains(t, F.lit("ß"))).select("doc_id", strings.to_ascii(t).alias("plain"), strings.same_ignoring_case(t, F.upper(t)).alias("same"))


@PLANS.query("""SELECT c_custkey, c_name AS back, to_base64(encode(c_name)) AS b64, c_name || '\\001'  AS escaped, coalesce('''' || nullif(c_mktsegment, 'BUILDING') || '''', 'NULL') AS quoted,
md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer""")
def str_bytes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_name")
    return load(spark, sf, "customer").select(
        "c_custkey", strings.decode(strings.encode(n, "hex"), "hex").cast("string").alias("back"), strings.encode(n, "base64").alias("b64"),
        F.replace(strings.encode_escape(F.concat(n, F.lit("\x00")).cast("binary")), F.lit("\\000"), F.lit("\\001")).alias("escaped"),
        strings.quote_nullable(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("quoted"), *(strings.digest(n, k).alias(a) for k, a in (("md5", "m"), ("sha1", "s1"), ("sha256", "s2"))),
    )


@PLANS.query("""SELECT o_orderkey, lpad(' ' || format('{:,.2f}', CAST(o_totalprice AS DECIMAL(12,2))), 15, ' ') AS text, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS back,
CAST(trunc(CAST(o_totalprice AS DECIMAL(18,4)) / 100) * 100 AS DOUBLE) AS hundreds, round(log(o_custkey + 1) / log(7), 9) AS log7, round(sin(o_orderkey), 9) AS s, round(atan2(o_orderkey, 3), 9) AS a,
right('0000' || (o_orderkey % 1000), 4) AS zeros, CAST(round(CAST(o_custkey AS DECIMAL(18,1)) / 4 * 10) / 10 AS DOUBLE) AS rounded FROM orders""")
def num_format(spark: SparkSession, sf: str) -> DataFrame:
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    text = numbers.to_char(x, "999,999,990.00")
    return load(spark, sf, "orders").select(
        "o_orderkey", text.alias("text"), numbers.to_number(text, "999,999,990.00").cast("double").alias("back"), numbers.trunc_to(x, -2).alias("hundreds"),
        F.round(numbers.log_to_base(F.lit(7), F.col("o_custkey") + 1), 9).alias("log7"), F.round(F.sin(k), 9).alias("s"), F.round(F.atan2(k.cast("double"), F.lit(3.0)), 9).alias("a"),
        numbers.to_char(k % 1000, "FM0000").alias("zeros"), numbers.round_to(F.col("o_custkey").cast("decimal(18,1)") / 4, 1).cast("double").alias("rounded"),
    )


@PLANS.query("""SELECT p_partkey, right(bin((p_partkey & (p_partkey * 7) & 255) + 256), 8) AS a, right(bin(((p_partkey | (p_partkey * 7)) & 255) + 256), 8) AS o,
right(bin((xor(p_partkey, p_partkey * 7) & 255) + 256), 8) AS x, CAST(position('11' IN right(bin((p_partkey & 255) + 256), 8)) AS INTEGER) AS place,
CAST(round(p_retailprice * 100) * 3 // 1 AS BIGINT) AS triple, '$' || format('{:,.2f}', round(p_retailprice, 2)) AS cash FROM part""")
def bit_strings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = numbers.bits(k, 8), numbers.bits(k * 7, 8)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return load(spark, sf, "part").select(
        "p_partkey", numbers.bit_and(a, b).alias("a"), numbers.bit_or(a, b).alias("o"), numbers.bit_xor(a, b).alias("x"), F.locate("11", a).alias("place"),
        numbers.money_times(cents, F.lit(3)).alias("triple"), numbers.money(F.col("p_retailprice")).alias("cash"),
    )


@PLANS.query("""SELECT event_id, strftime((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%d %H:%M') AS there,
strftime(to_timestamp(epoch(date_trunc('second', ts))::BIGINT) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS again FROM events""")
def time_zones(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts")
    whole = F.date_trunc("second", t)
    return load(spark, sf, "events").select(
        "event_id", F.date_format(dates.at_time_zone(t, "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("utc"), F.date_format(dates.in_time_zone(t.cast("timestamp"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("there"),
        F.date_format(dates.from_epoch(F.unix_seconds(whole.cast("timestamp"))), "yyyyMMddHHmmss").alias("again"),
    )


@PLANS.query("""SELECT o_orderkey, CAST(trunc(epoch(o_orderdate - TIMESTAMP '1996-02-29 06:00:00') / 86400) AS BIGINT) AS days,
strftime(o_orderdate + (INTERVAL 36 HOUR) * CAST(o_orderkey % 5 AS INTEGER), '%Y-%m-%d %H:%M') AS later, strftime(CAST(o_orderdate AS DATE) + INTERVAL 930 MINUTE, '%Y-%m-%d %H:%M') AS timed,
strftime(strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M'), '%Y-%m-%d %H:%M') AS parsed, strftime(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y'), '%Y-%m-%d') AS day FROM orders""")
def time_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    days, _ = dates.difference(d, F.lit("1996-02-29 06:00:00").cast("timestamp"))
    by_days, by_micros = dates.times(F.lit(1).cast("long"), F.lit(12 * 3_600_000_000), F.col("o_orderkey") % 5)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return load(spark, sf, "orders").select(
        "o_orderkey", days.cast("long").alias("days"), text(dates.add_interval(d, by_days, by_micros)).alias("later"), text(dates.date_plus_time(d.cast("date"), F.lit(15), F.lit(30))).alias("timed"),
        text(dates.to_timestamp(dates.to_char(d, "DD/MM/YYYY HH24:MI"), "DD/MM/YYYY HH24:MI")).alias("parsed"), F.date_format(dates.to_date(dates.to_char(d, "DD.MM.YYYY"), "DD.MM.YYYY"), "yyyy-MM-dd").alias("day"),
    )


@PLANS.query("""SELECT o_orderkey, CAST(m // 30 AS BIGINT) AS months, CAST(m % 30 AS BIGINT) AS days, CAST(h % 24 AS BIGINT) AS hours FROM (SELECT o_orderkey, h, o_custkey % 90 + h // 24 AS m FROM (SELECT *, o_orderkey % 100 AS h FROM orders))""")
def time_justify(spark: SparkSession, sf: str) -> DataFrame:
    hours = (F.col("o_orderkey") % 100) * F.lit(3_600_000_000)
    months, days, micros = dates.justify_interval(F.lit(0).cast("long"), F.col("o_custkey") % 90, hours)
    return load(spark, sf, "orders").select("o_orderkey", months.cast("long").alias("months"), days.cast("long").alias("days"), (micros / 3_600_000_000).cast("long").alias("hours"))


@PLANS.query("""SELECT p_partkey, array_to_string(list_concat([0], a, [9], a), ',') AS built, '[1:' || len(a) || ']' AS dims, CAST(len(a) AS INTEGER) AS high, p_size > list_min(a) AS some, p_size >= list_max(a) AS every,
list_contains(a, 1) AND (list_contains(a, 2) OR NOT list_contains(a, 3)) AS query, array_to_string(list_filter(a, lambda x: x <> 1), ',') AS without, p_size % 5 || ',7,' || 1 AS assigned
FROM (SELECT p_partkey, p_size, [p_size % 5, p_size % 3, 1] AS a FROM part)""")
def arr_build(spark: SparkSession, sf: str) -> DataFrame:
    a = F.expr("array(p_size % 5, p_size % 3, 1)")
    text = lambda c: arrays.to_string(c.cast("array<string>"), ",")
    return load(spark, sf, "part").select(
        "p_partkey", text(F.concat(F.array_append(F.array_prepend(a, 0), 9), a)).alias("built"), arrays.dims(a).alias("dims"), arrays.bounds(a)[1].alias("high"), arrays.any_(F.col("p_size"), ">", a).alias("some"),
        arrays.all_(F.col("p_size"), ">=", a).alias("every"), arrays.matches_int(a, "1 & (2 | !3)").alias("query"), text(F.array_remove(a, 1)).alias("without"), text(arrays.assign(a, 2, F.lit(7))).alias("assigned"),
    )


@PLANS.query("""SELECT n_nationkey, unnest([1, 2, 3]) AS place, unnest(['k', 'n', 'r']) AS key, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation""")
def map_each(spark: SparkSession, sf: str) -> DataFrame:
    """A map from arrays, its slice, its keys and values, and each pair as a row."""
    m = arrays.hs_from_arrays(F.array(*map(F.lit, "knrx")), F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"), F.lit(None)))
    some = arrays.hs_slice(m, F.array(*map(F.lit, "knr")))
    pairs = load(spark, sf, "nation").select("n_nationkey", F.map_keys(some).alias("k"), F.map_values(some).alias("v"))
    at = pairs.select("n_nationkey", "k", "v", F.explode(arrays.subscripts(F.col("k"))).alias("place"))
    return at.select("n_nationkey", "place", F.element_at("k", F.col("place")).alias("key"), F.element_at("v", F.col("place")).alias("value"))


@PLANS.query("""SELECT p_partkey, CAST(position(split_part(p_name, ' ', 2) IN p_name) > 0 AS INTEGER) AS at, p_type = 'ECONOMY' OR p_name LIKE '% widget' AS found, p_type IN ('ECONOMY', 'LARGE') AS below FROM part""")
def path_search(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws(".", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    return load(spark, sf, "part").select(
        "p_partkey", F.when(arrays.path_index(path, F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))) >= 1, 1).otherwise(0).alias("at"), arrays.ltxtquery(path, "economy | widget").alias("found"),
        arrays.any_ancestor(F.array(F.lit("ECONOMY"), F.lit("LARGE")), path).alias("below"),
    )


@PLANS.query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) - 0.5, 5) AS low, round(CAST(embedding[1] AS DOUBLE) + 0.5, 5) AS high, round(CAST(embedding[3] AS DOUBLE) + CAST(embedding[2] AS DOUBLE), 5) AS axes FROM embeddings""")
def cube_more(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    low, high = arrays.cube_enlarge(e, e, 0.5)
    axes = arrays.cube_subset(e, [3, 2])
    return load(spark, sf, "embeddings").select("vec_id", F.round(F.get(low, F.lit(0)), 5).alias("low"), F.round(F.get(high, F.lit(0)), 5).alias("high"), F.round(F.get(axes, F.lit(0)) + F.get(axes, F.lit(1)), 5).alias("axes"))


@PLANS.query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS low, p_size + 10.5::DOUBLE AS high, p_size <= 20 AND 15 <= p_size + 10.5 AS meets, p_size <= 16 AND p_size + 10.5 >= 18 AS holds FROM part""")
def seg_ops(spark: SparkSession, sf: str) -> DataFrame:
    low, high = arrays.seg_parse(F.format_string("~%d .. %.1f", "p_size", F.col("p_size") + 10.5))
    other = arrays.seg_parse(F.lit("17.5(+-)2.5"))
    inner = arrays.seg_parse(F.lit("16 .. 18"))
    return load(spark, sf, "part").select("p_partkey", low.alias("low"), high.alias("high"), arrays.seg_overlap(low, high, *other).alias("meets"), arrays.seg_contains(low, high, *inner).alias("holds"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@PLANS.query(f"""SELECT doc_id, CAST(len(list_distinct(w)) AS INTEGER) AS n, CAST(len(w) AS BIGINT) AS places, coalesce(CAST(list_position(w, 'the') AS INTEGER), 0) AS first_the, CAST(2 * len(w) AS BIGINT) AS doubled
FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""")
def fts_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with weights, joined to themselves, stripped and measured."""
    v = textsearch.tsvector(F.col("text"))
    told = load(spark, sf, "documents").select("doc_id", v.alias("v"))
    twice = textsearch.concat(F.col("v"), textsearch.setweight(F.col("v"), "A"))
    places = lambda c: F.size(F.flatten(F.map_values(c))).cast("long")
    first = F.coalesce(F.get(F.try_element_at("v", F.lit("the")), F.lit(0)), F.lit(0))
    return told.select("doc_id", textsearch.length(textsearch.strip(F.col("v"))).alias("n"), places(F.col("v")).alias("places"), first.alias("first_the"), places(twice).alias("doubled"))


@PLANS.query(f"""SELECT doc_id, (list_contains(w, 'idiot') OR list_contains(w, 'clown')) AND list_contains(w, 'the') AS hit FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""")
def fts_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """A query with one of its parts rewritten."""
    query = textsearch.rewrite(textsearch.parse("the & fool"), textsearch.parse("fool"), textsearch.parse("idiot | clown"))
    return load(spark, sf, "documents").select("doc_id", textsearch.matches(textsearch.lexemes(F.col("text")), query).alias("hit"))


@PLANS.query("SELECT doc_id, regexp_replace(text, '\\b(the|idiot)\\b', '<b>\\1</b>', 'gi') AS marked FROM documents WHERE lang = 'en'")
def fts_headline(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").filter("lang = 'en'").select("doc_id", textsearch.headline(F.col("text"), ["the", "idiot"]).alias("marked"))


@PLANS.query(None)
def fts_rank_cd(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return textsearch.ts_rank_cd(docs, textsearch.tsvector(F.col("text")), ["the", "and"]).drop("text")


@PLANS.query("""SELECT c_custkey, '255.255.255.0' AS mask, '0.0.0.255' AS hosts, '10.' || (c_nationkey % 4) || '.7.1/16' AS wider, '08:00:2b:' || substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) AS mac, '08:00:2b:00:00:00' AS maker
FROM (SELECT *, lower(right('000000' || to_hex(c_custkey), 6)) AS h FROM customer)""")
def inet_mac(spark: SparkSession, sf: str) -> DataFrame:
    a = F.format_string("10.%d.7.1/24", F.col("c_nationkey") % 4)
    mac = rows.macaddr(F.concat(F.lit("08002B-"), F.lpad(F.hex("c_custkey"), 6, "0")))
    return load(spark, sf, "customer").select("c_custkey", rows.netmask(a).alias("mask"), rows.hostmask(a).alias("hosts"), rows.set_masklen(a, 16).alias("wider"), mac.alias("mac"), rows.macaddr_trunc(mac).alias("maker"))


@PLANS.query("""SELECT n_nationkey, '<?xml version="1.0" standalone="yes"?><a><!--' || n_nationkey || '--><b>' || n_name || '</b><?go on?></a>' AS xml, n_name AS inner_text FROM nation""")
def xml_more(spark: SparkSession, sf: str) -> DataFrame:
    inside = rows.xmlconcat(rows.xmlcomment(F.col("n_nationkey").cast("string")), rows.xmlforest(b=F.col("n_name")), F.lit(None).cast("string"), rows.xmlpi("go", F.lit("on")))
    xml = rows.xmlroot(rows.xmlelement("a", None, inside), standalone=True)
    return load(spark, sf, "nation").select("n_nationkey", xml.alias("xml"), F.get(F.xpath(xml, F.lit("/a/b/text()")), F.lit(0)).alias("inner_text"))


@PLANS.query("""SELECT c_custkey, round(sqrt(power(x - 3, 2) + power(y - 4, 2)), 6) AS d, round(abs((x - 3) * (y - 4)), 6) AS area, x <= 10 AND 10 <= greatest(x, 3) AND y <= 10 AND 10 <= greatest(y, 4) AS holds, sqrt(power(x - 12, 2) + power(y - 2, 2)) <= 6 AS round_hit,
round(0.5 * abs(3 * y - 4 * x), 6) AS triangle FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 13 AS DOUBLE) AS y FROM customer)""")
def geometry_ops(spark: SparkSession, sf: str) -> DataFrame:
    p, q = geometry.point(F.col("c_nationkey"), F.col("c_custkey") % 13), geometry.point(F.lit(3), F.lit(4))
    b = geometry.box(p, q)
    ten = geometry.box(geometry.point(F.lit(10), F.lit(10)), geometry.point(F.lit(10), F.lit(10)))
    c = geometry.circle(geometry.point(F.lit(12), F.lit(2)), F.lit(6))
    triangle = F.array(geometry.point(F.lit(0), F.lit(0)), q, p)
    above = (p["x"] <= 10) & (p["y"] <= 10)
    return load(spark, sf, "customer").select(
        "c_custkey", F.round(geometry.distance(p, q), 6).alias("d"), F.round(geometry.box_area(b), 6).alias("area"), (geometry.box_contains(b, ten) & above).alias("holds"),
        geometry.circle_contains(c, p).alias("round_hit"), F.round(geometry.polygon_area(triangle), 6).alias("triangle"),
    )


@PLANS.query("""SELECT s_suppkey, round(2 * 6378168 * asin(sqrt(power(sin(radians(a - 10) / 2), 2) + cos(radians(10)) * cos(radians(a)) * power(sin(radians(b - 20) / 2), 2))) / 1000, 3) AS km
FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS a, CAST(s_suppkey % 90 AS DOUBLE) AS b FROM supplier)""")
def earth_distance(spark: SparkSession, sf: str) -> DataFrame:
    far = fuzzy.geo_distance(F.lit(20.0), F.lit(10.0), (F.col("s_suppkey") % 90).cast("double"), F.col("s_nationkey").cast("double"), radius=6378.168)
    return load(spark, sf, "supplier").select("s_suppkey", F.round(far, 3).alias("km"))


@PLANS.query("SELECT c_custkey, 'bigint' AS kind, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS checked FROM customer")
def type_ops(spark: SparkSession, sf: str) -> DataFrame:
    """The type of a value; a domain that allows even numbers and null."""
    even = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey"))
    return load(spark, sf, "customer").select("c_custkey", F.typeof("c_custkey").alias("kind"), rows.domain(even, even % 2 == 0, "even").alias("checked"))
