"""Text search: lexemes with places, boolean queries, statistics, ranks.

A tsvector is ``map<string, array<int>>``: lexemes and their places from 1.  A
place's weight (D, C, B, A as 0 to 3) stands above its ``PLACE_BITS``.  A query
is a tree of tuples: ``("word", text)``, ``("!", q)``, ``("&", p, q)``, ``("|", p, q)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE_BITS = 14
WEIGHTS = "DCBA"
#: What a place of each weight counts in a rank.
WORTH = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def words_of(text: Column) -> Column:
    """The lower-cased words (letters and digits) in order."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _runs(ordered: Column) -> Column:
    """(first, next) of the runs of equal elements of a sorted array."""
    n = F.size(ordered)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    def pairs(starts: Column) -> Column:
        ends = F.when(n > 0, F.array_append(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), n)).otherwise(F.array().cast("array<int>"))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("next")))

    return _let(starts, pairs)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tsvector(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Words with their places; stop words keep their places but give no lexeme
    (the simple dictionary).  One sort, then runs are cut by position."""
    placed = F.transform(words_of(text), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i")))
    if stop_words:
        placed = F.filter(placed, lambda p: ~p["w"].isin(*stop_words))

    def build(ordered: Column) -> Column:
        names, places = F.transform(ordered, lambda p: p["w"]), F.transform(ordered, lambda p: p["i"])
        return _let(F.struct(names.alias("n"), places.alias("p")), lambda z: _let(_runs(z["n"]), lambda runs: F.map_from_arrays(
            F.transform(runs, lambda r: F.get(z["n"], r["first"])), F.transform(runs, lambda r: F.slice(z["p"], r["first"] + 1, r["next"] - r["first"]))
        )))

    return _let(F.array_sort(placed), build)


def lexemes(text: Column) -> Column:
    """The distinct lower-cased words."""
    return F.array_distinct(words_of(text))


def strip(vector: Column) -> Column:
    return F.transform_values(vector, lambda _, p: F.slice(p, 1, 0))


def length(vector: Column) -> Column:
    return F.size(vector)


def setweight(vector: Column, weight: str) -> Column:
    mark = WEIGHTS.index(weight) << PLACE_BITS
    return F.transform_values(vector, lambda _, p: F.transform(p, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).bitwiseOR(F.lit(mark))))


def place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def concat(a: Column, b: Column) -> Column:
    """Two vectors; the places of ``b`` go on behind the last one of ``a``."""
    none = F.array().cast("array<int>")

    def joined(last: Column) -> Column:
        return F.map_zip_with(a, b, lambda _, x, y: F.concat(F.coalesce(x, none), F.transform(F.coalesce(y, none), lambda p: p + last)))

    return _let(F.coalesce(F.array_max(F.transform(F.flatten(F.map_values(a)), place_of)), F.lit(0)), joined)


def parse(query: str) -> tuple:
    """The tree of a query of words with ``& | !``, parentheses and ``word:*``."""
    tokens = re.findall(r"[&|!()]|[\w]+(?::\*)?", query.lower())
    at = 0

    def chain(sign: str, part) -> tuple:
        nonlocal at
        found = part()
        while at < len(tokens) and tokens[at] == sign:
            at += 1
            found = (sign, found, part())
        return found

    def either() -> tuple:
        return chain("|", lambda: chain("&", one))

    def one() -> tuple:
        nonlocal at
        token = tokens[at] if at < len(tokens) else ")"
        at += 1
        if token == "!":
            return ("!", one())
        if token == "(":
            found = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"syntax error in text search query: {query!r}")
            at += 1
            return found
        if token in "&|)":
            raise ValueError(f"syntax error in text search query: {query!r}")
        return ("word", token)

    found = either()
    if at < len(tokens):
        raise ValueError(f"syntax error in text search query: {query!r}")
    return found


def numnode(query: tuple) -> int:
    return 1 + sum(numnode(q) for q in query[1:] if isinstance(q, tuple))


def query_words(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "word" else set().union(*map(query_words, query[1:]))


def query_contains(a: tuple, b: tuple) -> bool:
    """a @> b: whether a has all words of b."""
    return query_words(b) <= query_words(a)


def rewrite(query: tuple, target: tuple, new: tuple | None) -> tuple | None:
    """``query`` with ``new`` (or nothing) wherever ``target`` stands, however the
    operands of & and | are ordered and nested."""

    def operands(q: tuple, sign: str) -> list[tuple]:
        return [x for part in q[1:] for x in operands(part, sign)] if q[0] == sign else [q]

    def shape(q: tuple):
        return (q[0], frozenset(map(shape, operands(q, q[0])))) if q[0] in "&|" else (q[0], *(shape(x) if isinstance(x, tuple) else x for x in q[1:]))

    def build(sign: str, parts: list[tuple]) -> tuple | None:
        found = None
        for part in parts:
            found = part if found is None else (sign, found, part)
        return found

    if shape(query) == shape(target):
        return new
    if query[0] == "word":
        return query
    if query[0] == "!":
        inner = rewrite(query[1], target, new)
        return inner and ("!", inner)
    sign, parts = query[0], operands(query, query[0])
    if target[0] == sign:
        wanted = [shape(q) for q in operands(target, sign)]
        if all(w in [shape(q) for q in parts] for w in wanted):
            parts = [q for q in parts if shape(q) not in wanted] + ([new] if new else [])
            return build(sign, parts)
    return build(sign, [q for q in (rewrite(q, target, new) for q in parts) if q is not None])


def query_text(query: tuple) -> str:
    if query[0] == "word":
        return f"'{query[1]}'"
    if query[0] == "!":
        return "!" + (query_text(query[1]) if query[1][0] in ("word", "!") else f"( {query_text(query[1])} )")
    parts = [f"( {query_text(q)} )" if query[0] == "&" and q[0] == "|" else query_text(q) for q in query[1:]]
    return f" {query[0]} ".join(parts)


def matches(words: Column, query: str | tuple) -> Column:
    """Whether an array of words satisfies a query."""
    kind, *parts = parse(query) if isinstance(query, str) else query
    if kind == "word":
        return F.exists(words, lambda w: F.startswith(w, F.lit(parts[0][:-2]))) if parts[0].endswith(":*") else F.array_contains(words, parts[0])
    if kind == "!":
        return ~matches(words, parts[0])
    left, right = (matches(words, q) for q in parts)
    return left & right if kind == "&" else left | right


def ts_stat(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, ndoc, nentry over all texts: counted within each text, so a text
    sends each of its words once."""
    told = docs.select(F.array_sort(words_of(F.col(text))).alias("w"))
    runs = told.select("w", F.explode(_runs(F.col("w"))).alias("r")).select(F.get("w", F.col("r.first")).alias("word"), (F.col("r.next") - F.col("r.first")).alias("n"))
    return runs.groupBy("word").agg(F.count("*").alias("ndoc"), F.sum("n").alias("nentry"))


def ts_rank(text: Column, words: list[str], weight: float = 0.1) -> Column:
    """Rank of an OR query: each lexeme's places count by 1/k squared in order,
    scaled by the limit of that sum, averaged over the query's words."""
    placed = words_of(text)
    limit = 1.64493406685

    def one(word: str) -> Column:
        n = F.size(F.filter(placed, lambda w: w == word))
        series = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.lit(weight) / (k * k))
        return series / limit

    return sum((one(w) for w in words[1:]), one(words[0])) / len(words)


def covers(places: list[np.ndarray]) -> list[tuple[int, int]]:
    """The shortest spans (first, last) that hold a place of every word, none
    inside another."""
    if any(len(p) == 0 for p in places):
        return []
    found = []
    for end in np.unique(np.concatenate(places)):
        starts = [p[np.searchsorted(p, end, "right") - 1] if p[0] <= end else -1 for p in places]
        if min(starts) >= 0 and (not found or min(starts) > found[-1][0]):
            if found and found[-1][1] == end:
                found.pop()
            found.append((int(min(starts)), int(end)))
    return found


def ts_rank_cd(df: DataFrame, vector: Column, words: list[str], name: str = "rank", normal: int = 0) -> DataFrame:
    """``df`` with the cover density of an AND query: each cover counts the mean
    worth of its places, divided by one and the words within it that are not
    asked for.  ``normal``: 1 divides by 1 + log of the length, 2 by the length, 8
    by the number of lexemes, 16 by 1 + its log; 32 gives rank / (rank + 1)."""
    worth = [WORTH[w] for w in WEIGHTS]
    low, own = (1 << PLACE_BITS) - 1, df.columns

    def rank(lists: list[list[int]]) -> float:
        packed = np.array([x for p in lists for x in p], np.int64)
        weight = {int(x & low): worth[int(x >> PLACE_BITS)] for x in packed}
        total = 0.0
        for a, b in covers([np.unique(np.array(p, np.int64) & low) for p in lists]):
            inside = [w for x, w in weight.items() if a <= x <= b]
            total += len(inside) / sum(1 / w for w in inside) / (1 + max(b - a - (len(inside) - 1), 0))
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = np.array([rank(p) for p in batch.column("_places").to_pylist()], float)
            n, m = (np.maximum(batch.column(c).to_numpy(), 1) for c in ("_tokens", "_lexemes"))
            for flag, by in ((1, 1 + np.log(n)), (2, n), (8, m), (16, 1 + np.log(m))):
                ranks = ranks / by if normal & flag else ranks
            ranks = ranks / (ranks + 1) if normal & 32 else ranks
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(ranks)], names=[*own, name])

    none = F.array().cast("array<int>")
    known = F.coalesce(vector, F.create_map().cast("map<string,array<int>>"))
    told = df.withColumn("_v", known)
    places = F.array(*(F.coalesce(F.try_element_at("_v", F.lit(w)), none) for w in words))
    told = told.select(*df.columns, places.alias("_places"), F.size(F.flatten(F.map_values("_v"))).alias("_tokens"), F.size("_v").alias("_lexemes"))
    return told.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def headline(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """The whole text with the words of a query marked, whatever their case."""
    names = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({names})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")


def synonyms(words: Column, table: dict[str, str]) -> Column:
    """The dictionary step: each word replaced by its synonym, if it has one."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))
