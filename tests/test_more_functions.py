"""Functions and operators that SQL on the tables doesn't show in full."""

import hashlib
import hmac
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater.functions import arrays, dates, fuzzy, geometry, numbers, rows, strings, textsearch
from tidewater.operators import aggregates, changes, joins, recursion
from tidewater.registry import QUERIES

L = F.lit
WORDS = [("kitten", "sitting"), ("", "abc"), ("abc", ""), ("flaw", "lawn"), ("a", "a")]
POINTS = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]


def edit_cost(a, b, insert, delete, change):
    """Turning a into b, by trying every way."""
    if not a or not b:
        return len(b) * insert + len(a) * delete
    kept = edit_cost(a[1:], b[1:], insert, delete, change) + (a[0] != b[0]) * change
    return min(kept, edit_cost(a, b[1:], insert, delete, change) + insert, edit_cost(a[1:], b, insert, delete, change) + delete)


def shape(*points):
    return F.array(*(geometry.point(L(x), L(y)) for x, y in points))


def cases():
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    box = geometry.box(geometry.point(L(2), L(0)), geometry.point(L(0), L(3)))
    far = geometry.box(geometry.point(L(5), L(5)), geometry.point(L(6), L(6)))
    day = 86_400_000_000
    return {
        "back_reference": (strings.regexp_replace(L("xaab"), r"([a-z])\1", "Z"), "xZb"),
        "back_reference_kept": (strings.regexp_replace(L("xaab"), r"([a-z])\1", r"<\1>"), "x<a>b"),
        "dot_stops_at_lines": (strings.regexp_replace(L("a\nb"), "a.b", "Z"), "a\nb"),
        "hmac": (strings.hmac_sha256(L("some data"), b"key"), hmac.new(b"key", b"some data", hashlib.sha256).hexdigest()),
        "hmac_long": (strings.hmac_sha256(L("x"), b"k" * 99), hmac.new(b"k" * 99, b"x", hashlib.sha256).hexdigest()),
        "uuid5": (strings.uuid5(ns, L("example.org")), str(uuid.uuid5(uuid.UUID(ns), "example.org"))),
        "initcap": (strings.initcap(L("hi THERE-you o'neil")), "Hi There-You O'Neil"),
        "escape": (strings.encode_escape(L(bytearray(b"a\\b\x00\xff"))), "a\\\\b\\000\\377"),
        "groups": (strings.regexp_match_groups(L("a1b2"), "([a-z])([0-9])"), [["a", "1"], ["b", "2"]]),
        "char_small": (numbers.to_char(L(0.5), "999.99"), "    .50"),
        "char_minus": (numbers.to_char(L(-12.3), "9999.9"), "  -12.3"),
        "char_over": (numbers.to_char(L(12345), "999"), " ###"),
        "char_after": (numbers.to_char(L(-7), "99MI"), " 7-"),
        "number_after": (numbers.to_number(L("1,234.50-"), "9,999.99MI").cast("double"), -1234.5),
        "trunc_minus": (numbers.trunc_to(L(-1.987), 1), -1.9),
        "round_minus": (numbers.round_to(L(-2.5).cast("decimal(5,1)"), 0).cast("int"), -3),
        "justify": (F.array(*dates.justify_interval(L(1).cast("long"), L(-1).cast("long"), L(3_600_000_000).cast("long"))), [0, 29, 3_600_000_000]),
        "justify_mixed": (F.array(*dates.justify_interval(L(0).cast("long"), L(1).cast("long"), L(-3_600_000_000).cast("long"))), [0, 0, day - 3_600_000_000]),
        "times": (F.array(*dates.times(L(3).cast("long"), L(0).cast("long"), L(0.5))), [1, day // 2]),
        "any_null": (arrays.any_(L(1), "=", F.array(L(2), L(None))), None),
        "all_null": (arrays.all_(L(1), "<", F.array(L(0), L(None))), False),
        "any_empty": (arrays.any_(L(1), "=", F.array().cast("array<int>")), False),
        "dims_empty": (arrays.dims(F.array()), None),
        "assign_beyond": (arrays.assign(F.array(L(1)), 3, L(9)), [1, None, 9]),
        "enlarge_shrinks": (F.array(*arrays.cube_enlarge(F.array(L(0.0)), F.array(L(1.0)), -2.0)), [[0.5], [0.5]]),
        "seg": (F.array(*arrays.seg_parse(L("<1.5 .. "))), [1.5, math.inf]),
        "path_index": (arrays.path_index(L("a.b.c.b"), L("b.c")), 1),
        "path_index_none": (arrays.path_index(L("a.b"), L("a.b.c")), -1),
        "is_of": (rows.is_of(L(1), "int", "bigint") & ~rows.is_of(L("a"), "int"), True),
        "costs": (F.array(*(fuzzy.levenshtein_with_costs(L(a), L(b), 2, 3, 4) for a, b in WORDS)), [edit_cost(a, b, 2, 3, 4) for a, b in WORDS]),
        "mac": (rows.macaddr(L("0800.2b01.02FF")), "08:00:2b:01:02:ff"),
        "xml_root": (rows.xmlroot(L('<?xml version="1.0"?><a/>'), "1.1"), '<?xml version="1.1"?><a/>'),
        "box_area": (geometry.box_area(box), 6.0),
        "box_apart": (geometry.box_intersection(box, far).isNull() & geometry.box_left_of(box, far), True),
        "box_center": (geometry.box_center(box)["y"], 1.5),
        "polygon_in": (geometry.polygon_contains(shape(*POINTS), geometry.point(L(0.5), L(2))), True),
        "polygon_notch": (geometry.polygon_contains(shape(*POINTS), geometry.point(L(2), L(3))), False),
        "path_length": (geometry.path_length(shape((0, 0), (3, 4), (3, 6))), 7.0),
        "segment": (geometry.segment_distance(geometry.point(L(5), L(4)), geometry.point(L(0), L(0)), geometry.point(L(2), L(0))), 5.0),
        "circles": (geometry.circle_overlaps(geometry.circle(geometry.point(L(0), L(0)), L(1)), geometry.circle(geometry.point(L(3), L(0)), L(2))), True),
        "synonyms": (textsearch.synonyms(F.array(L("big"), L("cat")), {"big": "large"}), ["large", "cat"]),
        "vector": (textsearch.tsvector(L("The cat, the hat"), ("hat",)), {"the": [1, 3], "cat": [2]}),
        "vector_empty": (textsearch.tsvector(L("")), {}),
        "concat": (textsearch.concat(textsearch.tsvector(L("a b")), textsearch.tsvector(L("b"))), {"a": [1], "b": [2, 3]}),
    }


def test_values(spark):
    found = cases()
    got = spark.range(1).select(*(column.alias(name) for name, (column, _) in found.items())).first()
    wrong = {n: (got[n], want) for n, (_, want) in found.items() if not ((got[n] == pytest.approx(want)) if isinstance(want, float) else got[n] == want)}
    assert not wrong


def test_query_trees():
    q = textsearch.parse("a & (b | !c:*)")
    assert textsearch.numnode(q) == 6 and textsearch.query_text(q) == "'a' & ( 'b' | !'c:*' )"
    assert textsearch.query_contains(q, textsearch.parse("b | a")) and not textsearch.query_contains(q, textsearch.parse("d"))
    assert textsearch.rewrite(textsearch.parse("a & b & c"), textsearch.parse("c & a"), textsearch.parse("d")) == ("&", ("word", "b"), ("word", "d"))
    assert textsearch.rewrite(textsearch.parse("a | b"), textsearch.parse("b"), None) == ("word", "a")
    assert textsearch.rewrite(textsearch.parse("!a"), textsearch.parse("a"), None) is None
    for bad in ("a &", "(a", "a b", "&", ""):
        with pytest.raises(ValueError):
            textsearch.parse(bad)


def test_covers_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        places = [np.unique(rng.integers(1, 25, rng.integers(0, 6))) for _ in range(rng.integers(1, 4))]
        spans = [(a, b) for a in range(1, 25) for b in range(a, 25) if all(((p >= a) & (p <= b)).any() for p in places)]
        best = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
        assert textsearch.covers(places) == sorted(best, key=lambda s: s[1])


def test_changes_and_their_rows(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", 5), (2, "b", 5), (None, "c", 7)], "k int, t string, n int")
    _, changed = changes.update(table, {"n": F.col("n") + 1, "t": F.upper("t")}, F.col("n") > 4)
    assert sorted(map(tuple, changed.collect()), key=str) == [(2, "B", 6), (2, "B", 6), (None, "C", 8)]
    source = spark.createDataFrame([(2, 10), (2, 9), (3, 1), (None, 4)], "k int, v int")
    done, changed = changes.update_from(table, source, ["k"], {"n": F.col("v")})
    assert sorted(map(tuple, done.collect()), key=str) == [(1, "a", None), (2, "b", 9), (2, "b", 9), (None, "c", 7)] and changed.count() == 2
    kept, gone = changes.delete(table, F.col("n") > 5)
    assert kept.count() == 3 and [r.t for r in gone.collect()] == ["c"]
    with pytest.raises(ValueError):
        changes.insert(table, source)
    assert changes.insert(table, source.select("k").limit(0))[0].count() == 4


@pytest.mark.parametrize("sign", list(arrays.COMPARE))
@pytest.mark.parametrize("some", [True, False])
@pytest.mark.parametrize("right", [[], [1, 3], [None], [2, 2], [1, None], [2, None]])
def test_quantified_comparison(spark, sign, some, right):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    s = spark.createDataFrame([(v,) for v in right], "v int")
    got = (joins.compare_any if some else joins.compare_all)(left, "x", sign, s, "v", "r")

    def want(x):
        each = [None if x is None or v is None else bool({"=": x == v, "<>": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[sign]) for v in right]
        if some in each:
            return some
        return None if None in each else not some

    assert {r.x: r.r for r in got.collect()} == {x: want(x) for x in (1, 2, None)}


def test_paths_and_random_values(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "parent int, child int")
    got = {(tuple(r.path), r.cycle) for r in recursion.paths(edges, spark.createDataFrame([(1,)], "node int")).collect()}
    assert got == {((1,), False), ((1, 2), False), ((1, 2, 3), False), ((1, 2, 4), False), ((1, 2, 3, 1), True)}
    told = aggregates.normal_rand(spark, 20000, 5.0, 3.0, 3).agg(F.avg("value"), F.stddev("value")).first()
    assert abs(told[0] - 5) < 0.1 and abs(told[1] - 3) < 0.1


def test_rank_by_cover_density(spark):
    texts = spark.createDataFrame([("cat x hat y y cat",), ("cat x",), ("",), (None,)], "t string")
    v = textsearch.tsvector(F.col("t"))
    got = textsearch.ts_rank_cd(textsearch.ts_rank_cd(texts, v, ["cat", "hat"], "r"), textsearch.setweight(v, "A"), ["cat", "hat"], "w", 32).collect()
    assert [r.r for r in got] == pytest.approx([0.1 / 2 + 0.1 / 3, 0.0, 0.0, 0.0])
    assert [r.w for r in got] == pytest.approx([(5 / 6) / (1 + 5 / 6), 0.0, 0.0, 0.0])


def test_interval_sums_beyond_one_interval(spark):
    spans = spark.range(3).select(F.make_dt_interval(days=F.lit(100_000_000), hours=F.lit(30), secs=F.lit(-0.5)).alias("s"))
    told = spans.agg(aggregates.interval_sum(F.col("s")).alias("t")).first().t
    assert (told.days, float(told.seconds)) == (300_000_003, 3 * (6 * 3600 - 0.5))


def test_concat_reads_the_first_vector_once(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.concat(F.lit("w"), (i % 5000).cast("string"))), " ")
    v = spark.range(1).select(textsearch.tsvector(F.concat(text, F.lit(" end"))).alias("v")).localCheckpoint()
    df = v.select(textsearch.concat(F.col("v"), textsearch.setweight(F.col("v"), "A")).alias("c"))
    inside = df._jdf.queryExecution().optimizedPlan().toString().partition("map_zip_with")[2]
    assert inside and "array_max" not in inside  # else all places are read for each place
    assert df.select("c.w1").first()[0] == [1, 5001, (3 << textsearch.PLACE_BITS) + 10_002, (3 << textsearch.PLACE_BITS) + 15_002]


def test_inherited_self_join_counts_before_it_joins(spark, tmp_path):
    """Two million pairs of one key come from one row of each side."""
    spark.range(2000).select(F.format_string("s%d", "id").alias("s_name"), F.lit(7).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1000).select(F.format_string("c%d", "id").alias("c_name"), F.lit(7).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    df = QUERIES["join_inherited_self"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert plan.count("Aggregate", join) == 2
    assert {(r.left_table, r.right_table): r.pairs for r in df.collect()} == {("supplier", "supplier"): 4_000_000, ("customer", "supplier"): 2_000_000}
