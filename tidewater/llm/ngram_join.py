"""Grouped prefix join of documents on the Jaccard similarity of shingle sets.

1.  Documents with the same set are one class; the smallest id stands for it.
2.  A global order of shingles puts those found in many documents last.  They
    are marked in a bitmap of fixed size (``BITMAP_BITS``) by a count over all
    shingles of all documents; a hash orders the rest.
3.  A class's prefix is so long that two similar sets must share a shingle of
    their prefixes.  Classes with the same prefix and size form one group, and
    only groups are joined on shingles.
4.  Each group is first compared with the smallest group that shares most of
    its prefix, and its members with their first.  Links found so join groups
    into components, and only groups of different components are paired then:
    a crowd of near copies costs one comparison each, not one for each pair.
5.  Pairs of groups are met on the first shingle they can share, filtered by
    size and by the bound that shared prefix shingles set to the overlap.  The
    parts of one group that lie in different components share all of its prefix
    and are paired by group.  Pairs are expanded to members and verified on the
    whole sets.  No link between components is lost.

Defined cases: a null text is empty; texts without words have no shingles and
link with nothing; texts shorter than a shingle are one shingle; rows with the
same id are one node; a null id links with nothing and has a null component;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shared import clean_text, materialize, mix, split_words, text_slices, windows

BITMAP_BITS = 26
#: A shingle in at least this many documents goes last; more in a large corpus,
#: so that at most a quarter of the bitmap is set.
FREQUENT = 32
#: A range of shingles for about so many documents.
RANGE_DOCS = 1024
#: A class of at least so many rows (more, if that makes over ``HOT_CLASSES`` of
#: them possible) isn't joined by its key, which one task would get.
HOT_ROWS, HOT_CLASSES = 1000, 10_000


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle keys of each text."""
    flat, offsets = split_words(pc.ascii_lower(text))
    encoded = flat.dictionary_encode()
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(encoded.dictionary))
    codes = words[encoded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)
    keys, starts = windows(codes, offsets, width)
    bounds = np.searchsorted(starts, offsets)
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            out.append(np.unique(keys[a:b]))
        elif offsets[i + 1] > offsets[i]:
            whole = b" ".join(w.encode() for w in flat[offsets[i] : offsets[i + 1]].to_pylist())
            out.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=1)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def required(n: Column, percent: int) -> Column:
    """The least overlap of a set of ``n`` with any similar set."""
    return F.ceil(F.lit(percent) * n / F.lit(100)).cast("long")


def frequent_bitmap(docs: DataFrame, width: int) -> np.ndarray:
    """Bits of the key space that hold a shingle of many documents.

    Tasks send the 32 highest bits of their shingles with counts, cut by range,
    one row a range; each range is merged alone and gives its part of the
    bitmap.  There are more ranges the more documents there are, so a range stays
    small.  The driver gets the bitmap only, 8 MB at any size.
    """
    spark = docs.sparkSession
    bits = min(20, max(8, (docs.count() // RANGE_DOCS).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                sets = shingle_sets(clean_text(batch), width)
                top = np.sort((np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(32)).astype(np.uint32))
                first = np.nonzero(np.concatenate([[True], top[1:] != top[:-1]]))[0] if len(top) else np.empty(0, np.int64)
                keys, times = top[first], np.minimum(np.diff(np.append(first, len(top))), 255).astype(np.uint8)
                cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
                ends = np.append(cuts[1:], len(keys))
                ranges = np.nonzero(ends > cuts)[0]
                if len(ranges):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ranges.astype(np.int32)),
                            pa.array([keys[cuts[r] : ends[r]].tobytes() for r in ranges], pa.binary()),
                            pa.array([times[cuts[r] : ends[r]].tobytes() for r in ranges], pa.binary()),
                        ],
                        names=["range", "keys", "times"],
                    )

    def merge(part: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(part["keys"].to_pylist()), np.uint32)
        times = np.frombuffer(b"".join(part["times"].to_pylist()), np.uint8).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, total = keys[order], np.cumsum(times[order])
        last = np.nonzero(np.append(keys[1:] != keys[:-1], True))[0]
        sums = np.diff(total[last], prepend=0)
        often = sums >= FREQUENT
        return pa.table(
            {
                "range": part["range"].slice(0, 1),
                "shingles": pa.array([int(total[-1])], pa.int64()),
                "keys": pa.array([keys[last][often].tobytes()], pa.binary()),
                "times": pa.array([sums[often].astype(np.int64).tobytes()], pa.binary()),
            }
        )

    sent = docs.select("text").mapInArrow(count, "range int, keys binary, times binary")
    found = materialize(sent.groupBy("range").applyInArrow(merge, "range int, shingles bigint, keys binary, times binary"), "frequent")
    least = max(FREQUENT, (found.agg(F.sum("shingles")).first()[0] or 0) >> (BITMAP_BITS - 2))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, keys, times in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "times")), strict=True):
                often = np.frombuffer(keys, np.uint32)[np.frombuffer(times, np.int64) >= least].astype(np.int64)
                out.append(np.unique((often >> (32 - BITMAP_BITS)) - (r << (BITMAP_BITS - bits))).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(out, pa.binary())], names=["range", "bits"])

    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r, marked in found.mapInArrow(draw, "range int, bits binary").collect():
        at = np.frombuffer(marked, np.int32).astype(np.int64) + (r << (BITMAP_BITS - bits))
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bitmap


def prefixes(docs: DataFrame, width: int, percent: int, bitmap: np.ndarray) -> DataFrame:
    """doc_id, n, k1 and k2 (a digest of the set) and the prefix of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for whole in batches:
            for batch in text_slices(whole):
                sets = shingle_sets(clean_text(batch), width)
                out, k1, k2 = [], [], []
                for keys in sets:
                    at = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    often = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                    size = len(keys) + (percent * len(keys) + 99) // 100 * -1 + 1 if len(keys) else 0
                    order = np.argsort(often, kind="stable")[:size]
                    out.append(keys[order].view(np.int64))
                    k1.append(int(keys.sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(mix(keys).sum(dtype=np.uint64).view(np.int64)))
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                flat = pa.array(np.concatenate([*out, np.empty(0, np.int64)]))
                arrays = [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "k1", "k2", "prefix"])

    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, prefix array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


ID_BITS, PAGE_BITS = 26, 16


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, keys (the set) of the rows whose id is in ``ids`` (id), and of some
    others: a bitmap of fixed size lets hardly any other row through."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_slots(batch.column("id").to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> PAGE_BITS), pa.array(at & (1 << PAGE_BITS) - 1)], names=["page", "slot"])

    def pack(part: pa.Table) -> pa.Table:
        marks = np.zeros(1 << PAGE_BITS, bool)
        marks[part["slot"].to_numpy()] = True
        return pa.table({"page": part["page"].slice(0, 1), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    slots = ids.select("id").mapInArrow(mark, "page bigint, slot bigint").distinct()  # a page has 2**PAGE_BITS rows at most
    bitmap = np.zeros(1 << (ID_BITS - 3), np.uint8)  # 8 MB at any size
    for page, packed in slots.groupBy("page").applyInArrow(pack, "page bigint, bits binary").toLocalIterator():
        bitmap[page << (PAGE_BITS - 3) : (page + 1) << (PAGE_BITS - 3)] = np.frombuffer(packed, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = _slots(whole.column("doc_id").to_numpy().astype(np.int64))
            bits = shared.value
            wanted = whole.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            for batch in text_slices(wanted):
                keys = [s.tobytes() for s in shingle_sets(clean_text(batch), width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary())], names=["id", "keys"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "id bigint, keys binary")
    return materialize(rows, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ka"), batch.column("kb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) and len(y):
                    at = np.searchsorted(x, y)
                    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ka", "kb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _possible(n1: Column, n2: Column, shared: Column, percent: int) -> Column:
    """Whether sets of n1 and n2 with so many common prefix shingles can be
    similar: beyond a prefix, at most ``required - 1`` more can be common."""
    least = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    return shared + F.greatest(required(n1, percent), required(n2, percent)) - 1 >= least


def _first_place(pos: Column, n: Column, other: Column, percent: int) -> Column:
    """Whether the first shingle that two similar sets share can stand at
    ``pos`` of the one of ``n``: all others they need to share come later."""
    return pos <= n - F.ceil(F.lit(percent) * (n + other) / F.lit(100 + percent))


def _sizes(n1: Column, n2: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2)


def class_members(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """doc_id, rep of every row of (doc_id, n, k1, k2).

    Classes of one row need no join.  Those of many rows, of which there cannot
    be more than ``HOT_CLASSES``, are sent to all tasks; the others are joined.
    """
    key = ["n", "k1", "k2"]
    least = max(HOT_ROWS, total // HOT_CLASSES + 1)
    hot = F.broadcast(classes.filter(F.col("m") >= least).select(*key, "rep"))
    few = classes.filter((F.col("m") > 1) & (F.col("m") < least)).select(*key, "rep")
    cold = rows.join(hot, key, "left_anti").join(few, key, "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    return rows.join(hot, key).select("doc_id", "rep").union(cold)


def similar_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, class_id, component_id), one for each row of
    ``docs``, and links (a, b) between classes that span the components."""
    col: Callable[[str], Column] = F.col
    rows = materialize(prefixes(docs, width, percent, frequent_bitmap(docs, width)), "prefixes")
    filled = rows.filter("n > 0 and doc_id is not null")
    # 1. one class for each distinct set, led by the smallest id; an id with several texts joins their classes
    classes = materialize(filled.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), "classes")
    member = materialize(class_members(filled.select("doc_id", "n", "k1", "k2"), classes, rows.count()).distinct(), "members")
    leads = filled.withColumn("ph", F.xxhash64("prefix")).join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "k1", "k2"])
    leads = leads.select(col("doc_id").alias("rep"), "n", "k1", "k2", "ph", "prefix")
    leads = materialize(leads.dropDuplicates(["n", "k1", "k2"]).select("rep", "n", "ph", "prefix"), "leads")
    # 3. groups of classes with the same prefix and size
    groups = leads.groupBy("n", "ph").agg(F.min("rep").alias("g"))
    grouped = materialize(leads.select("rep", "n", "ph").join(groups, ["n", "ph"]).select("rep", "n", "g"), "grouped")
    heads = leads.join(groups.select("n", "ph", "g"), ["n", "ph"]).filter("rep = g").select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    first = heads.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("g", "n")).alias("r")).filter("m > 1")
    crowd = grouped.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g")
    tokens = materialize(heads.join(first.select("token", "r"), "token").select("token", "pos", "g", "n", col("r.g").alias("r"), col("r.n").alias("rn")), "tokens")
    # 4. first links: to the group that shares most of the prefix, and within groups
    near = tokens.filter("g <> r").groupBy("g", "r", "n", "rn").count().filter(_sizes(col("n"), col("rn"), percent))
    near = near.filter(_possible(col("n"), col("rn"), col("count"), percent))
    best = near.groupBy("g").agg(F.max(F.struct("count", (-col("r")).alias("r"))).alias("best"))
    stars = best.select(col("g").alias("a"), (-col("best.r")).alias("b")).union(
        grouped.join(crowd, "g").filter("rep <> g").select(col("rep").alias("a"), col("g").alias("b"))
    )
    stars = materialize(stars, "stars")
    ids = stars.select(col("a").alias("id")).union(stars.select(col("b").alias("id"))).distinct()
    star_links = materialize(verified(stars, sets_of(docs, ids, width), percent), "links")
    found = components(star_links)
    # 5. pairs of groups from different components
    placed = grouped.join(found, grouped.rep == found.node, "left").select("rep", "n", "g", F.coalesce("component", "rep").alias("c"))
    placed = materialize(placed, "placed")
    cells = placed.groupBy("g", "c").agg(F.min("rep").alias("cell"))
    held = tokens.select("token", "pos", "g", "n").join(cells, "g").select("token", "pos", "n", "cell", "c")
    mixed = held.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    held = materialize(held.join(mixed, "token"), "held")
    x = held.filter(_first_place(col("pos"), col("n"), col("n"), percent)).select("token", col("pos").alias("p1"), col("n").alias("n1"), col("cell").alias("x"), col("c").alias("c1"))
    y = held.select("token", col("pos").alias("p2"), col("n").alias("n2"), col("cell").alias("y"), col("c").alias("c2"))
    smaller = (col("n1") < col("n2")) | ((col("n1") == col("n2")) & (col("x") < col("y")))
    early = _first_place(col("p1"), col("n1"), col("n2"), percent) & _first_place(col("p2"), col("n2"), col("n1"), percent)
    pairs = x.join(y, "token").filter(smaller & (col("c1") != col("c2")) & _sizes(col("n1"), col("n2"), percent) & early)
    prefix = cells.join(leads.select(col("rep").alias("g"), "prefix"), "g").select("cell", "prefix")
    pairs = pairs.select("x", "y", "n1", "n2").distinct()
    pairs = pairs.join(prefix.select(col("cell").alias("x"), col("prefix").alias("px")), "x").join(prefix.select(col("cell").alias("y"), col("prefix").alias("py")), "y")
    pairs = pairs.filter(_possible(col("n1"), col("n2"), F.size(F.array_intersect("px", "py")), percent)).select("x", "y")
    # parts of one group: its shingles may be in no other group, and then ``tokens`` has none of them
    torn = materialize(cells.join(cells.groupBy("g").count().filter("count > 1").select("g"), "g").select("g", "c", "cell"), "torn")
    parts = torn.select("g", col("c").alias("c1"), col("cell").alias("x")).join(torn.select("g", col("c").alias("c2"), col("cell").alias("y")), "g")
    pairs = pairs.union(parts.filter((col("x") < col("y")) & (col("c1") != col("c2"))).select("x", "y")).distinct()
    inside = placed.join(cells, ["g", "c"]).select("cell", "rep")
    pairs = pairs.join(inside.select(col("cell").alias("x"), col("rep").alias("a")), "x").join(inside.select(col("cell").alias("y"), col("rep").alias("b")), "y")
    pairs = materialize(pairs.select("a", "b"), "pairs")
    ids = pairs.select(col("a").alias("id")).union(pairs.select(col("b").alias("id"))).distinct()
    links = star_links
    if not pairs.isEmpty():
        links = materialize(star_links.union(verified(pairs, sets_of(docs, ids, width), percent)), "links")
    # components of ids: links between classes, and each id with its classes
    same = member.filter("doc_id <> rep").select(col("doc_id").alias("a"), col("rep").alias("b"))
    several = same.groupBy("a").count().filter("count > 1").select("a")
    odd = same.join(several, "a")
    node = materialize(components(links.union(odd)), "components")
    place = member.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
    place = place.join(node.select(col("node").alias("class_id"), "component"), "class_id", "left")
    place = place.select(col("doc_id").alias("id"), "class_id", F.coalesce("component", "class_id").alias("component"))
    out = rows.select("doc_id", col("n").alias("n_shingles")).join(place, col("doc_id") == col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id")), links


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id, and all
    without words or id; the columns of ``docs``."""
    found, _ = similar_documents(docs, width, percent)
    leads = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("times"))
    leads = materialize(leads, "leads")
    kept = docs.join(leads.select("doc_id"), "doc_id", "left_semi")
    if not leads.filter("times > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    kept = kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.union(docs.filter("doc_id is null"))
