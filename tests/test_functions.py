"""Values that the functions must give, one expression each."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import arrays, dates, fuzzy, numbers, rows, strings, textsearch

L = F.lit


def ints(*x):
    return F.array(*(L(i) for i in x)).cast("array<int>")


def cases():
    return {
        "similar": (strings.similar_to(L("abcdefg"), "_bcd%"), True),
        "similar_part": (strings.similar_to(L("abcdefg"), "bcd%"), False),
        "similar_escape": (strings.similar_to(L("a%b"), "a#%b", "#"), True),
        "replace_first": (strings.regexp_replace(L("1112223333"), r"(\d{3})(\d{3})(\d{4})", r"(\1) \2-\3"), "(111) 222-3333"),
        "replace_one": (strings.regexp_replace(L("AAA"), "A", "Z"), "ZAA"),
        "replace_all": (strings.regexp_replace(L("AAA aaa"), "A+", "Z", "gi"), "Z Z"),
        "substring": (strings.substring_regex(L("abcdefg"), "a(b.d)e"), "bcd"),
        "quote": (strings.quote_literal(L("it's")), "'it''s'"),
        "ident": (strings.quote_ident(L("Some Name")), '"Some Name"'),
        "chr": (strings.chr_(L(8364)), "€"),
        "char_n": (strings.char_n(L("abcdef"), 4), "abcd"),
        "bpchar": (strings.bpchar_eq(L("a   "), L("a")), True),
        "words": (strings.cash_words(L(123456)), "One thousand two hundred thirty four dollars and fifty six cents"),
        "div": (numbers.int_div(L(-7), L(2)), -3),
        "to_int": (numbers.to_int(L(2.5)), 2),
        "to_int_odd": (numbers.to_int(L(3.5)), 4),
        "bits": (numbers.bits(L(10), 6), "001010"),
        "shift": (numbers.bit_shift(L("001010"), 6, 2), "101000"),
        "shift_right": (numbers.bit_shift(L("001010"), 6, -1), "000101"),
        "money": (numbers.money(L(-1234.5)), "-$1,234.50"),
        "dow": (dates.part("dow", L("2024-01-07").cast("timestamp")), 0.0),
        "century": (dates.part("century", L("2000-12-31").cast("timestamp")), 20.0),
        "epoch": (dates.part("epoch", L("1970-01-02 00:00:01.5").cast("timestamp")), 86401.5),
        "trunc": (dates.trunc("century", L("1999-05-05").cast("timestamp")).cast("date").cast("string"), "1901-01-01"),
        "overlaps": (dates.overlaps(L(1), L(3), L(3), L(5)), False),
        "overlaps_swapped": (dates.overlaps(L(4), L(1), L(3), L(5)), True),
        "clamp": (dates.add_months_stepwise(L("2023-01-31").cast("date"), L(2), 1).cast("string"), "2023-03-28"),
        "to_char": (dates.to_char(L("2024-03-05").cast("timestamp"), "DD Mon YYYY"), "05 Mar 2024"),
        "contains": (arrays.contains(ints(1, 2, 3), ints(3, 1)), True),
        "slice": (arrays.slice_(ints(1, 2, 3), 2, 9), [2, 3]),
        "uniq": (arrays.uniq(ints(1, 1, 2, 1)), [1, 2, 1]),
        "lca": (arrays.lca(L("a.b.c"), L("a.b.d.e")), "a.b"),
        "ancestor": (arrays.is_ancestor(L("a.b"), L("a.bc")), False),
        "lquery": (arrays.lquery(L("Top.Science.Astronomy"), "*.sci*@.!x"), True),
        "lquery_not": (arrays.lquery(L("Top.Science.x"), "*.Science.!x"), False),
        "cube_size": (arrays.cube_size(F.array(L(0.0), L(0.0)), F.array(L(2.0), L(3.0))), 6.0),
        "cube_in": (arrays.cube_contains(ints(0, 0), ints(9, 9), ints(1, 1), ints(2, 2)), True),
        "trgm": (fuzzy.show_trgm(L("word")), ["  w", " wo", "ord", "rd ", "wor"]),
        "sim": (F.round(fuzzy.similarity(L("word"), L("two words")), 6), 0.363636),
        "costs": (fuzzy.levenshtein_with_costs(L("kitten"), L("sitting"), 1, 2, 3), 7),
        "difference": (fuzzy.difference(L("Anne"), L("Andrew")), 2),
        "vector": (textsearch.tsvector(L("a fat cat sat on a mat"), ("a", "on")), {"cat": [3], "fat": [2], "mat": [7], "sat": [4]}),
        "match": (textsearch.matches(textsearch.lexemes(L("fat cats ate")), "fat & (rat | cat:*) & !dog"), True),
        "enum": (rows.enum_order(L("green"), ["red", "green"]), 2),
        "xml": (rows.xmlelement("a", {"b": L('x"y'), "c": L(None).cast("string")}), '<a b="x&quot;y"/>'),
        "net": (rows.network(L("192.168.77.5/20")), "192.168.64.0/20"),
        "within": (rows.within(L("192.168.1.0/24"), L("192.168.0.0/16")), True),
    }


def test_values(spark):
    wanted = cases()
    found = spark.range(1).select(*(c.alias(k) for k, (c, _) in wanted.items())).first()
    assert {k: found[k] for k in wanted} == {k: v for k, (_, v) in wanted.items()}


def test_bad_query(spark):
    with pytest.raises(ValueError, match="syntax error"):
        textsearch.matches(F.array(), "a & (b")


def test_domain_rejects(spark):
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(rows.domain(L(-1), L(-1) > 0, "positive").alias("x")).collect()
