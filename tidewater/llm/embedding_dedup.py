"""Near duplicates among embeddings by randomised-rotation binary codes.

Vectors are scaled to length one and turned by random rotations.  What is stored
of a vector (its record) are the signs of the turned components, a correction
factor (how far the code points from the vector), and the turned components in
``LEVELS`` steps with random rounding, as bit planes; for ``TURNS`` rotations.  One
record's code and another's planes give an unbiased estimate of their inner
product.  The mean over rotations and over both ways round has a bound that holds
with ``DEVIATIONS`` standard deviations, which the factors give.  Records are
unpacked in the task, where all estimates of a bucket are one product of small
matrices.

1.  Parts of the codes (bands) place records in buckets, in so many tables that a
    pair at the threshold is met with ``RECALL``.  Only records are shuffled.  A
    vector that no bound in its bucket lets reach the threshold is done there.
2.  The vectors of the others are joined to their buckets, and pairs within the
    bounds are recomputed exactly.

Equal vectors are one weighted vector.  A bucket with more than ``BLOCK`` rows
is cut into blocks and every two blocks meet in a task of their own.  Links are
counted where a pair first meets, so none counts twice; pairs are never
emitted: a task returns a count and one edge to its local component for each of
its vectors.  A pair that no table brings together is not found: its chance is
``1 - RECALL`` at the threshold and less above it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and stand alone; vectors of unlike length do not
link; repeated rows are vectors that link with each other; a null id takes part
in counts but names no component (a component of null ids only has a null id
and isn't kept); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shared import materialize, mix

THRESHOLD = 0.9
RECALL = 0.998
DEVIATIONS = 3.5
BLOCK = 2048
#: Buckets hold about so many vectors.
BUCKET = 512
SEED = 20
#: Rows of a bucket estimated at a time, and pairs recomputed at a time.
ROWS, PAIRS = 128, 1 << 16
#: Rotations that estimates use; bands take more if they need more bits.
TURNS = 2
PLANES = 4
LEVELS = (1 << PLANES) - 1


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, side by side (dim x count*dim)."""
    rng = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], 1)


def tables(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of tables for so many vectors."""
    bits = min(24, max(4, round(math.log2(max(rows, 2) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))


@dataclass
class Records:
    """What is stored of vectors: words of sign bits, words of bit planes, and
    (factor, lowest level, step) of each rotation used for estimates."""

    dim: int
    code: np.ndarray
    planes: np.ndarray
    scale: np.ndarray

    def packed(self) -> list[bytes]:
        return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(self.code, self.planes, self.scale, strict=True)]

    def signs(self) -> np.ndarray:
        """Rows by rotations by components: 0 or 1."""
        return _bits(self.code, self.dim)

    def keys(self, bits: int, count: int) -> np.ndarray:
        """The ``count`` band keys of each row."""
        signs = self.signs().reshape(len(self.code), -1)[:, : bits * count].reshape(len(self.code), count, bits)
        return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _words(bits: np.ndarray) -> np.ndarray:
    """The last axis of a boolean array as little-endian 64-bit words."""
    room = -bits.shape[-1] % 64
    padded = np.concatenate([bits, np.zeros((*bits.shape[:-1], room), bool)], -1)
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def _bits(words: np.ndarray, dim: int) -> np.ndarray:
    """Rows of words as rows by parts by ``dim`` bits."""
    wide = -(-dim // 64) * 8
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1, wide), axis=2, bitorder="little")[:, :, :dim]


def make_records(unit: np.ndarray, turns: int, seeds: np.ndarray) -> Records:
    """``seeds``: one number a row, which its rounding depends on."""
    n, dim = unit.shape
    turned = (unit @ rotations(dim, max(turns, TURNS))).reshape(n, -1, dim)
    code = _words(turned > 0).reshape(n, -1)
    used = turned[:, :TURNS]
    low = used.min(2)
    step = np.maximum((used.max(2) - low) / LEVELS, 1e-12)
    dither = mix(mix(seeds.astype(np.uint64))[:, None] + np.arange(TURNS * dim, dtype=np.uint64)).astype(np.float64) / 2.0**64
    level = np.clip(np.floor((used - low[:, :, None]) / step[:, :, None] + dither.reshape(used.shape)), 0, LEVELS).astype(np.int64)
    planes = _words((level[:, :, None, :] >> np.arange(PLANES)[:, None]) & 1 > 0).reshape(n, -1)
    factor = np.abs(used).sum(2) / math.sqrt(dim)  # the code's inner product with its vector
    return Records(dim, code, planes, np.stack([factor, low, step], 2).astype(np.float32))


def read_records(packed: pa.Array, dim: int, turns: int) -> Records:
    words = -(-dim // 64)
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    a = words * max(turns, TURNS) * 8
    b = a + words * TURNS * PLANES * 8
    code, planes, scale = (np.ascontiguousarray(x) for x in (raw[:, :a], raw[:, a:b], raw[:, b:]))
    return Records(dim, code.view("<u8"), planes.view("<u8"), scale.view(np.float32).reshape(len(packed), TURNS, 3))


@dataclass
class Estimator:
    """Unpacked records: ``left @ right.T`` is the mean of the estimates from one
    record's levels and the other's code, both ways round; ``spread`` is each
    record's part of its variance."""

    left: np.ndarray
    right: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, records: Records) -> Estimator:
        n, dim = len(records.code), records.dim
        factor, low, step = (records.scale[:, :, k] for k in range(3))
        signs = records.signs()[:, :TURNS].astype(np.float32) * 2 - 1
        code = signs / (math.sqrt(dim) * factor)[:, :, None]
        planes = _bits(records.planes, dim).reshape(n, TURNS, PLANES, dim)
        level = (planes << np.arange(PLANES, dtype=np.uint8)[:, None]).sum(2, dtype=np.uint8).astype(np.float32)
        value = low[:, :, None] + step[:, :, None] * level
        # the code's error, and the rounding of the other's levels under this code
        error = np.maximum(1 - factor**2, 0) / max(dim - 1, 1) / factor**2 + (step / 2) ** 2 / np.minimum(factor, 1) ** 2
        left = np.concatenate([value, code], 1).reshape(n, -1) / (2 * TURNS)
        return cls(left, np.concatenate([code, value], 1).reshape(n, -1), error.sum(1) / (2 * TURNS) ** 2)

    def take(self, at: np.ndarray) -> Estimator:
        return Estimator(self.left[at], self.right[at], self.spread[at])


def upper(left: Estimator, right: Estimator) -> np.ndarray:
    """Upper confidence bounds of all inner products of two sets of records."""
    return left.left @ right.right.T + DEVIATIONS * np.sqrt(left.spread[:, None] + right.spread[None])


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, vec_id, embedding) to (rid, vec_id, dim, vector as doubles; null if
    it cannot link)."""
    for batch in batches:
        out, dims = [], []
        for v in batch.column("embedding"):
            x = None
            if v.is_valid and len(v) and v.values.null_count == 0:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
            out.append(None if x is None else x.tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["rid", "vec_id", "dim", "vector"]
        )


def unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bounds(unit: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the inner products of ``unit`` with ``other``."""
    left, right = (Estimator.of(make_records(x, 1, np.arange(len(x)))) for x in (unit, other))
    return upper(left, right)


def possible_pairs(left: Estimator, right: Estimator, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs whose bound reaches the threshold, some rows
    at a time; i < j if ``same``."""
    for a in range(0, len(left.spread), ROWS):
        maybe = upper(left.take(np.s_[a : a + ROWS]), right) >= threshold
        if same:
            maybe &= np.arange(a, a + len(maybe))[:, None] < np.arange(len(right.spread))[None]
        i, j = np.nonzero(maybe)
        yield i + a, j


def first_met(keys: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether table ``t`` is the first in which rows i and j share a bucket."""
    seen = np.zeros(len(i), bool)
    for u in range(t):
        seen |= keys[i, u] == keys[j, u]
    return ~seen


def bucket_pairs(records: Records, mine: np.ndarray, r: int, s: int, t: int, bits: int, count: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of blocks r and s within the bounds that share a bucket of table t,
    and of no table before."""
    keys, told = records.keys(bits, count), Estimator.of(records)
    order = np.argsort(keys[:, t], kind="stable")
    ranked = keys[order, t]
    cuts = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))[0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        here = order[a:b]
        left, right = (here, here) if r == s else (here[mine[here] == r], here[mine[here] == s])
        if b - a > 1 and len(left) and len(right):
            for i, j in possible_pairs(told.take(left), told.take(right), r == s, threshold):
                i, j = left[i], right[j]
                new = first_met(keys, t, i, j)
                yield i[new], j[new]


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding")
    rows = materialize(rows.mapInArrow(_usable, "rid bigint, vec_id bigint, dim int, vector binary"), "vectors")
    distinct = rows.filter("vector is not null").groupBy("dim", "vector").agg(F.min("rid").alias("rep"), F.count("*").alias("weight"))
    bits, count = tables(rows.count(), threshold)
    coarse = min(bits, 31)

    def turns(dim: int) -> int:
        return -(-bits * count // dim)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the record and the bucket in each table."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for a in range(0, part.num_rows, 4096):
                    some = part.slice(a, 4096)
                    made = make_records(unit_rows(some.column("vector"), int(dim)), turns(int(dim)), some.column("rep").to_numpy())
                    places = made.keys(bits, count) >> (bits - coarse)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * count), pa.array(places.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made.packed(), pa.binary()), lists], names=[*some.schema.names, "record", "places"])

    stored = distinct.mapInArrow(store, "dim int, vector binary, rep bigint, weight bigint, record binary, places array<int>")
    distinct = materialize(stored, "records")
    placed = distinct.select("rep", "dim", "record", F.posexplode("places").alias("t", "p"))
    # buckets of more than a block are cut into blocks, every two of which meet
    large = placed.groupBy("dim", "t", "p").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    large = large.select("dim", "t", "p", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = placed.join(large, ["dim", "t", "p"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"r": F.least("mine", "other"), "s": F.greatest("mine", "other")})
    cell = ["dim", "t", "p", "r", "s"]

    def opened(part: pa.Table) -> tuple[list[int], Records, np.ndarray]:
        place = [part[c][0].as_py() for c in cell]
        return place, read_records(part["record"].combine_chunks(), place[0], turns(place[0])), part["mine"].to_numpy()

    def estimate(part: pa.Table) -> pa.Table:
        """The vectors that some bound lets reach the threshold."""
        (_, t, _, r, s), records, mine = opened(part)
        near = np.zeros(part.num_rows, bool)
        for i, j in bucket_pairs(records, mine, r, s, t, bits, count, threshold):
            near[i] = near[j] = True
        return part.select(["rep", *cell, "mine"]).filter(pa.array(near))

    def recompute(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part["rep"]))
        (dim, t, _, r, s), records, mine = opened(part)
        unit = unit_rows(part["vector"].combine_chunks(), dim)
        rep, weight = part["rep"].to_numpy(), part["weight"].to_numpy()
        links = np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))
        for i, j in bucket_pairs(records, mine, r, s, t, bits, count, threshold):
            exact = np.concatenate([np.einsum("ij,ij->i", unit[i[a : a + PAIRS]], unit[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)] or [np.empty(0)])
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            root = local_components(len(rep), np.concatenate([i, np.arange(len(rep))]), np.concatenate([j, root]))
        told = np.nonzero((links > 0) | (root != np.arange(len(rep))))[0]
        return pa.table({"rep": rep[told], "links": links[told], "root": rep[root[told]]})

    near = met.drop("other", "blocks").repartition(*cell).groupBy(*cell).applyInArrow(estimate, "rep bigint, dim int, t int, p int, r int, s int, mine int")
    near = materialize(near, "near").join(distinct.select("rep", "weight", "vector", "record"), "rep").repartition(*cell)
    told = materialize(near.groupBy(*cell).applyInArrow(recompute, "rep bigint, links bigint, root bigint"), "links")
    found = components(told.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    counts = told.groupBy("rep").agg(F.sum("links").alias("links"))
    each = distinct.select("dim", "vector", "rep", "weight").join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(each, ["dim", "vector"], "left").select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "rid").alias("c"))
    out = materialize(out, "linked")
    names = out.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    out = out.join(names, "c")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
