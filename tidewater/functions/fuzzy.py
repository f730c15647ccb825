"""Similar strings: trigrams, sound codes, edit distance, great circles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def show_trgm(text: Column) -> Column:
    """Distinct trigrams of the words, each led by two blanks and closed by one."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all; 0 without any."""
    x, y = show_trgm(a), show_trgm(b)
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(every > 0, both / every).otherwise(F.when(every.isNotNull(), F.lit(0.0)))


def difference(a: Column, b: Column) -> Column:
    """Places in which two sound codes agree, 0 to 4."""
    x, y = F.soundex(a), F.soundex(b)
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(2, 5)), (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int"))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_with_costs(a: Column, b: Column, insert: int, delete: int, change: int) -> Column:
    """Edit distance with costs; a row of the table is folded for each
    character of ``a``, within the JVM."""
    right = F.filter(F.split(b, ""), lambda c: c != "")
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: (i * insert).cast("int"))

    def next_row(row: Column, c: Column) -> Column:
        # fold along b: the array so far grows by one cell for each character
        start = F.array((F.get(row, F.lit(0)) + delete).cast("int"))
        return F.aggregate(
            F.transform(right, lambda d, j: F.struct(d.alias("d"), j.alias("j"))), start,
            lambda out, e: F.array_append(out, F.least(F.element_at(out, -1) + insert, F.get(row, e["j"] + 1) + delete, F.get(row, e["j"]) + F.when(c == e["d"], 0).otherwise(change)).cast("int")),
        )

    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), first, next_row), -1)


def geo_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 3958.747716) -> Column:
    """Great-circle distance in statute miles (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p1 - p2) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
