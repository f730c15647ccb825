"""Arrays, integer sets, maps, vectors of a cube, labels of a path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import textsearch


def contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def slice_(a: Column, low: int, high: int) -> Column:
    """a[low:high], counted from 1; bounds beyond the ends are cut."""
    low = max(low, 1)
    return F.slice(a, low, high - low + 1) if high >= low else F.slice(a, 1, 0)


#: Comparisons by their signs.
COMPARE = {
    "=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def any_(x: Column, sign: str, a: Column) -> Column:
    """x sign ANY (array): true, false, or null if only nulls keep it from false."""
    return F.exists(a, lambda y: COMPARE[sign](x, y))


def all_(x: Column, sign: str, a: Column) -> Column:
    return F.forall(a, lambda y: COMPARE[sign](x, y))


def dims(a: Column) -> Column:
    """``[1:n]``; null for an empty array."""
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a), F.lit("]")))


def ndims(a: Column) -> Column:
    return F.when(F.size(a) > 0, 1)


def bounds(a: Column) -> tuple[Column, Column]:
    """The lowest and highest subscript; null for an empty array."""
    return ndims(a), F.when(F.size(a) > 0, F.size(a))


def subscripts(a: Column) -> Column:
    """All subscripts, to be exploded."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def assign(a: Column, at: int, value: Column) -> Column:
    """a[at] := value; beyond the end, nulls fill the gap."""
    grown = F.concat(a, F.array_repeat(F.lit(None), F.greatest(F.lit(at) - F.size(a), F.lit(0))))
    return F.transform(grown, lambda x, i: F.when(i == at - 1, value).otherwise(x))


def matches_int(a: Column, query: str) -> Column:
    """A boolean query of integers, such as ``1&(2|3)&!4``."""
    return textsearch.matches(a.cast("array<string>"), query)


def to_string(a: Column, delimiter: str) -> Column:
    return F.array_join(a, delimiter)


def from_string(text: Column, delimiter: str) -> Column:
    return F.split(text, re.escape(delimiter))


def uniq(a: Column) -> Column:
    """Neighbours that are equal become one."""
    n = F.size(a)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
    return F.transform(kept, lambda i: F.get(a, i))


# maps


def hs_concat(a: Column, b: Column) -> Column:
    """Two maps; the right one's values win."""
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def hs_delete(a: Column, key: Column) -> Column:
    return F.map_filter(a, lambda k, _: k != key)


def hs_contains(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & F.element_at(a, e["key"]).eqNullSafe(e["value"]))


def hs_defined(a: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(a, key).isNotNull(), F.lit(False))


def hs_from_arrays(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def hs_slice(a: Column, keys: Column) -> Column:
    return F.map_filter(a, lambda k, _: F.array_contains(keys, k))


# cubes: the corners as two arrays


def cube_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cube_union(la: Column, ha: Column, lb: Column, hb: Column) -> tuple[Column, Column]:
    return F.zip_with(la, lb, F.least), F.zip_with(ha, hb, F.greatest)


def cube_inter(la: Column, ha: Column, lb: Column, hb: Column) -> tuple[Column, Column]:
    return F.zip_with(la, lb, F.greatest), F.zip_with(ha, hb, F.least)


def cube_size(low: Column, high: Column) -> Column:
    return F.aggregate(F.zip_with(low, high, lambda a, b: F.abs(b - a)), F.lit(1.0), lambda s, x: s * x)


def cube_contains(la: Column, ha: Column, lb: Column, hb: Column) -> Column:
    return F.forall(F.arrays_zip(la.alias("a"), ha.alias("b"), lb.alias("c"), hb.alias("d")), lambda z: (z["a"] <= z["c"]) & (z["d"] <= z["b"]))


def cube_overlap(la: Column, ha: Column, lb: Column, hb: Column) -> Column:
    return F.forall(F.arrays_zip(la.alias("a"), ha.alias("b"), lb.alias("c"), hb.alias("d")), lambda z: (z["a"] <= z["d"]) & (z["c"] <= z["b"]))


def cube_enlarge(low: Column, high: Column, by: float) -> tuple[Column, Column]:
    """Moved apart by ``by`` on each side; where that turns a side round, it
    becomes the middle."""
    wide = F.zip_with(low, high, lambda a, b: F.struct((a - by).alias("a"), (b + by).alias("b"), ((a + b) / 2).alias("m")))
    return F.transform(wide, lambda z: F.when(z["a"] > z["b"], z["m"]).otherwise(z["a"])), F.transform(wide, lambda z: F.when(z["a"] > z["b"], z["m"]).otherwise(z["b"]))


def cube_subset(corner: Column, axes: list[int]) -> Column:
    """Axes of a corner, counted from 1, in the order named."""
    return F.array(*(F.element_at(corner, k) for k in axes))


# line segments (intervals of numbers): low and high


def seg_parse(text: Column) -> tuple[Column, Column]:
    """``a .. b``, ``a ..``, ``.. b``, ``a(+-)d`` or ``a``; marks of certainty
    (``< > ~``) are passed over."""
    number = r"([-+]?[0-9.]*[0-9](?:[eE][-+]?[0-9]+)?)"
    bare = F.regexp_replace(text, "[<>~ ]", "")
    around = bare.rlike(rf"^{number}\(\+-\){number}$")
    middle, by = (F.regexp_extract(bare, rf"^{number}\(\+-\){number}$", k).try_cast("double") for k in (1, 2))
    ranged = F.contains(bare, F.lit(".."))
    left, right = F.split_part(bare, F.lit(".."), F.lit(1)).try_cast("double"), F.split_part(bare, F.lit(".."), F.lit(2)).try_cast("double")
    one = bare.try_cast("double")
    low = F.when(around, middle - by).when(ranged, F.coalesce(left, F.lit(float("-inf")))).otherwise(one)
    high = F.when(around, middle + by).when(ranged, F.coalesce(right, F.lit(float("inf")))).otherwise(one)
    return low, high


def seg_overlap(la: Column, ha: Column, lb: Column, hb: Column) -> Column:
    return (la <= hb) & (lb <= ha)


def seg_contains(la: Column, ha: Column, lb: Column, hb: Column) -> Column:
    return (la <= lb) & (hb <= ha)


# label paths


def nlevel(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, offset: int, length: int) -> Column:
    return F.array_join(F.slice(F.split(path, r"\."), offset + 1, length), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b: a is b or above it."""
    return (a == "") | (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


def lca(a: Column, b: Column) -> Column:
    """The longest common path above both."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    most = F.least(F.size(x), F.size(y)) - 1
    same = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda n: (n <= most) & (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n)))
    return F.array_join(F.slice(x, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), ".")


def path_index(path: Column, part: Column) -> Column:
    """Where the labels of ``part`` first stand in ``path``, from 0; -1 if nowhere."""
    x, y = F.split(path, r"\."), F.split(part, r"\.")
    places = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.slice(x, i, F.size(y)) == y)
    return F.coalesce(F.array_min(places) - 1, F.lit(-1))


def ltxtquery(path: Column, query: str) -> Column:
    """A boolean query of whole labels, case ignored, in any place."""
    return textsearch.matches(F.split(F.lower(path), r"\."), query)


def any_ancestor(paths: Column, path: Column) -> Column:
    """Whether one of an array of paths is ``path`` or above it."""
    return F.exists(paths, lambda p: is_ancestor(p, path))


def lquery(path: Column, query: str) -> Column:
    """Path patterns: ``*``, ``*{n}``, ``*{n,m}``, ``a|b``, ``!a``, ``a*``, ``a@``."""
    out = ""
    for level in query.split("."):
        if m := re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", level):
            low, comma, high = m[1] or "0", m[2], m[3]
            bound = "*" if m[1] is None else f"{{{low}}}" if not comma else f"{{{low},{high}}}"
            out += rf"(?:[A-Za-z0-9_]+\.){bound}"
            continue
        negated = level.startswith("!")
        options = []
        for label in level.lstrip("!").split("|"):
            name = re.match(r"[A-Za-z0-9_]*", label)[0]
            flags = label[len(name) :]
            options.append(("(?i:" if "@" in flags else "(?:") + re.escape(name) + ")" + ("[A-Za-z0-9_]*" if "*" in flags else ""))
        joined = "|".join(options)
        out += rf"(?!(?:{joined})\.)[A-Za-z0-9_]+\." if negated else rf"(?:{joined})\."
    return F.concat(path, F.lit(".")).rlike(f"^{out}$")
