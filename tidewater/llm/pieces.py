"""Piece ids of texts by a relational lattice of substrings, and back.

A text is a run of units: it is cut (blanks are written ``▁``; one is put before
the text) wherever no piece holds the two neighbouring characters, so that no
piece can cross a cut.  Each distinct unit is encoded once:

1.  its substrings of bounded length are exploded and joined to the piece table;
2.  the pieces found, the edges of its lattice, are grouped by unit;
3.  a Viterbi fold with Spark's ``aggregate`` keeps, for every position, the best
    edge that ends there, and a second fold walks back from the end.

For unigram tables the best path has the largest sum of scores.  The scores of a
merge table are ranks, not log probabilities; its encoding is the one path on
which every two neighbours stay apart when encoded together.  So each edge
carries the lengths of the edges before it that it may follow (``Merges``), and
the same fold takes the only path that is allowed.

Units often found in a bounded sample of texts (``HEAD_UNITS`` of ``SAMPLE_DOCS``)
are encoded first and sent to all tasks, which changes the cost but not the
result; a text's other units are dealt by unit with their places, and joined to
the text by its two hashes (96 bits): texts are packed into codes of one to four bytes a unit where
they are read, and only these are shuffled.  Units of over ``LONGEST`` characters
would cost the square of their length in a fold; they go to the library.

Defined cases: a null or empty text has no ids; a literal ``▁`` is a blank;
characters without a piece become their bytes; repeated rows stay apart; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.encode import default_path
from tidewater.llm.shared import clean_text, give_back, materialize, string_keys, text_slices
from tidewater.llm.token_counts import head_threshold

VOCABULARY = "piece_bpe_32k.model"
HEAD_UNITS = 1 << 19
SAMPLE_DOCS = 40_000
#: Characters of a unit of the head at most, and parts that the places of a longer one are dealt in.
HEAD_LENGTH, PARTS = 64, 64
#: Numbers of units that take one byte.
ONE = 192
#: Names whose keys are made at a time.
NAMES = 1 << 15
LONGEST = 2048
#: Texts whose rare units a task has sent; beyond so many it starts anew and may send some twice.
SENT_TEXTS = 1 << 20
#: Edges whose predecessors are looked up at a time.
EDGES = 1 << 17
#: Units whose lists of edges a task holds at once (some hundred bytes each).
GROUPS = 1 << 17
_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
BLANK = "▁"
UNKNOWN = -1


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_rows(path: str) -> pa.Table:
    """id, piece, score of the pieces that stand in texts (no control or byte
    pieces): as many rows as the vocabulary has."""
    sp = processor(path)
    rows = [(i, sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ids, names, scores = zip(*rows, strict=True)
    return pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(names), "score": pa.array(scores)})


@lru_cache(maxsize=2)
def neighbours(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character that stands in a piece (0 for all others), and
    which two of them stand side by side in some piece."""
    names = piece_rows(path)["piece"].to_pylist()
    number = np.zeros(0x110000, np.int32)
    letters = sorted(set().union(*names))
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    beside = np.zeros((len(letters) + 1,) * 2, bool)
    for n in names:
        at = number[[ord(c) for c in n]]
        beside[at[:-1], at[1:]] = True
    return number, beside


class Merges:
    """Which two pieces of a merge table stay apart when encoded together.

    Taking two pieces' merges back, latest first, shows every pair of symbols
    that ever stood at their border; a merge of such a pair that comes before the
    one taken back last would have joined them.
    """

    def __init__(self, table: pa.Table):
        names = table["piece"].to_pylist()
        self.ids = table["id"].to_numpy()
        place = {n: i for i, n in enumerate(names)}
        order = np.argsort(-table["score"].to_numpy(), kind="stable")
        self.rank = np.empty(len(names), np.int64)
        self.rank[order] = np.arange(len(names))
        single = np.array([len(n) == 1 for n in names])
        self.left, self.right = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        self.reachable = single.copy()
        made: dict[int, int] = {}
        for i, n in enumerate(names):
            for k in range(1, len(n)):
                a, b = place.get(n[:k]), place.get(n[k:])
                if a is not None and b is not None:
                    made[a * len(names) + b] = int(self.rank[i])
        for i, n in enumerate(names):
            if len(n) > 1 and (split := self._last_merge([place.get(c, -1) for c in n], made, order, len(names))) is not None:
                self.left[i], self.right[i] = split
                self.reachable[i] = True
        self.rank[single] = -1
        self.keys = np.array(sorted(made), np.int64)
        self.made = np.array([made[int(k)] for k in self.keys], np.int64)
        self.size = len(names)

    @staticmethod
    def _last_merge(symbols: list[int], made: dict[int, int], order: np.ndarray, size: int) -> tuple[int, int] | None:
        while len(symbols) > 1:
            ranks = [made.get(a * size + b, size) if a >= 0 <= b else size for a, b in zip(symbols, symbols[1:], strict=False)]
            k = ranks.index(min(ranks))
            if ranks[k] == size:
                return None
            both = (symbols[k], symbols[k + 1])
            symbols = [*symbols[:k], int(order[ranks[k]]), *symbols[k + 2 :]]
        return both

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places of left and right pieces in the table."""
        x, y = a.copy(), b.copy()
        limit, ok = np.full(len(x), self.size + 1), np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            key = x[live] * self.size + y[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joined = (self.keys[at] == key) & (self.made[at] < limit[live])
            ok[live[joined]] = False
            live = live[~joined]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live, rx, ry = (z[(rx >= 0) | (ry >= 0)] for z in (live, rx, ry))
            later = rx > ry  # of two equal merges the left one comes first
            limit[live] = np.where(later, rx, ry + 1)
            x[live[later]] = self.right[x[live[later]]]
            y[live[~later]] = self.left[y[live[~later]]]
        return ok


def cut_units(units: pa.Array, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Units cut between characters that no piece holds side by side: all parts,
    and where each unit's parts start."""
    units = clean_text(pa.RecordBatch.from_arrays([units], names=["text"]))
    ends = np.frombuffer(units.buffers()[1], np.int64, len(units) + 1)
    raw = units.buffers()[2].to_pybytes()[: ends[-1]]
    number, beside = pairs
    code = number[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
    begin = np.nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[0]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    cut[begin[1:][~beside[code[:-1], code[1:]]]] = True
    cuts = np.nonzero(cut)[0]
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)), np.cumsum(cut)[ends] - 1


def blank_units(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of blanks with what follows up to the next blank (each once; some may
    not occur), the run of each place and where each text starts."""
    lists = pc.split_pattern(text, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    full = (pc.binary_length(encoded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(text)), np.diff(offsets))
    at = np.nonzero(full)[0]
    before = np.maximum(np.append(-1, at[:-1]) + 1, offsets[:-1][doc[at]]) if len(at) else at
    blanks = at - before + 1
    # what is left behind the last part of a text is a unit of blanks alone
    last = offsets[:-1].copy()
    np.maximum.at(last, doc[at], at + 1)
    rest = np.where(pc.binary_length(text).to_numpy(zero_copy_only=False) > 0, offsets[1:] - last, 0)
    tails = np.nonzero(rest > 0)[0]
    places = np.concatenate([at * 2, offsets[1:][tails] * 2 - 1])
    code = np.concatenate([codes[at], np.full(len(tails), -1)])
    lead = np.concatenate([blanks, rest[tails]])
    order = np.argsort(places, kind="stable") if len(tails) else slice(None)
    counts = np.bincount(np.concatenate([doc[at], tails]).astype(np.int64), minlength=len(text))
    # a part behind one blank is known by its code; the few others are told apart by code and blanks
    odd = np.nonzero((lead != 1) | (code < 0))[0]
    kinds, own = np.unique(((code[odd] + 1) << 32) | lead[odd], return_inverse=True)
    unit = code.copy()
    unit[odd] = len(encoded.dictionary) + own.ravel()
    parts = encoded.dictionary
    more = pa.concat_arrays([pa.array([""], parts.type), parts]).take(pa.array(kinds >> 32))
    none = pa.scalar("", parts.type)
    units = pc.binary_join_element_wise(pa.scalar(BLANK, parts.type), parts, none) if len(parts) else parts
    if len(kinds):
        units = pa.concat_arrays([units, pc.binary_join_element_wise(pa.array([BLANK * int(k) for k in kinds & 0xFFFFFFFF], parts.type), more, none)])
    return units, unit[order], np.concatenate([[0], np.cumsum(counts)])


def text_units(text: pa.Array, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the unit of each place and where each text starts."""
    runs, places, starts = blank_units(text)
    if not len(places):
        return runs.slice(0, 0), places, starts
    parts, first = cut_units(runs, pairs)
    encoded = parts.dictionary_encode()
    size = np.diff(first)[places]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1][places] - ends[:-1], size) + np.arange(ends[-1])
    return encoded.dictionary, encoded.indices.to_numpy()[at].astype(np.int64), ends[starts]


def lattice(units: DataFrame, pieces: DataFrame, longest_piece: int) -> DataFrame:
    """unit and its edges: the start, size and place (in the piece table) of each
    substring that is a piece, as one number.

    ``units`` come dealt by unit, and substrings stay with their unit's task, so
    the grouping shuffles nothing.  The empty substring keeps units without any,
    and their ``places``, if there are such; further columns tell units apart.
    """
    keys, carried = [c for c in units.columns if c != "places"], "places" in units.columns
    at = units.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("unit"))))
    if carried:
        at = at.withColumn("places", F.when(F.col("at") == 1, F.col("places")))
    first = F.when(F.col("at") == 1, 0).otherwise(1)
    spans = at.withColumn("size", F.explode(F.sequence(first, F.least(F.lit(longest_piece), F.length("unit") - F.col("at") + 1))))
    spans = spans.withColumn("piece", F.substr("unit", F.col("at"), F.col("size")))
    if carried:
        spans = spans.withColumn("places", F.when(F.col("size") == 0, F.col("places")))
    known = pieces.select("piece", "place").union(pieces.sparkSession.sql("SELECT '' AS piece, 0L AS place"))
    found = spans.join(F.broadcast(known), "piece")  # the vocabulary: a fixed size
    edge = (F.col("at") - 1).cast("long") * (1 << 32) + F.col("size") * (1 << 24) + F.col("place")
    more = [F.first("places", ignorenulls=True).alias("places")] if carried else []
    return found.groupBy(*keys).agg(F.collect_list(edge).alias("edges"), *more)


def _edge_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``EDGES`` edges each."""
    ends = batch.column("edges").offsets.to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + EDGES, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def follow_batches(table: pa.Table, merges: Merges | None, unknown: float):
    """For ``mapInArrow``: units with their edges to units and, for each end position, the
    edges there: size, id, score and the sizes of edges that it may follow."""
    ids, score = table["id"].to_numpy().astype(np.int64), table["score"].to_numpy()

    def allowed(prev: np.ndarray, here: np.ndarray) -> np.ndarray:
        if merges is None:
            return np.ones(len(prev), bool)
        both = (prev >= 0) & (here >= 0)
        keys, back = np.unique(prev[both] * len(ids) + here[both], return_inverse=True)
        out = np.ones(len(prev), bool)
        out[both] = merges.apart(keys // len(ids), keys % len(ids))[back]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _edge_slices(whole):
                length = pc.utf8_length(batch.column("unit")).to_numpy(zero_copy_only=False).astype(np.int64)
                lists = batch.column("edges")
                packed = lists.flatten().to_numpy()
                unit = np.repeat(np.arange(len(length)), np.diff(lists.offsets.to_numpy()))
                real = ((packed >> 24) & 0xFF) > 0
                packed, unit = packed[real], unit[real]
                base = np.concatenate([[0], np.cumsum(length + 1)])  # a node before and behind each character
                start, size, place = base[unit] + (packed >> 32), (packed >> 24) & 0xFF, packed & 0xFFFFFF
                if merges is not None:
                    kept = merges.reachable[place]
                    start, size, place = start[kept], size[kept], place[kept]
                # characters without a piece
                bare = np.ones(base[-1], bool)
                bare[start[size == 1]] = False
                bare[base[1:] - 1] = False
                bare = np.nonzero(bare)[0]
                start, size, place = np.concatenate([start, bare]), np.concatenate([size, np.ones(len(bare), np.int64)]), np.concatenate([place, np.full(len(bare), UNKNOWN)])
                order = np.argsort((start + size) * 32 + size, kind="stable")
                start, size, place = start[order], size[order], place[order]
                count = np.bincount(start + size, minlength=base[-1])
                bounds = np.concatenate([[0], np.cumsum(count)])
                before = count[start]
                first = np.concatenate([[0], np.cumsum(before)])
                prev = np.repeat(bounds[start] - first[:-1], before) + np.arange(first[-1])
                here = np.repeat(np.arange(len(start)), before)
                after = np.bincount(here, (allowed(place[prev], place[here])) * (1 << size[prev]), len(start)).astype(np.int32)
                opens = np.zeros(base[-1], bool)
                opens[base[:-1]] = True
                after += opens[start]
                node = ~opens  # each unit's positions 1, 2, ...
                inner = np.concatenate([[0], np.cumsum(count[node])]).astype(np.int32)
                outer = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                known_place = np.maximum(place, 0)
                value = np.where(place >= 0, 0.0 if merges is not None else score[known_place], unknown)
                edge = pa.StructArray.from_arrays(
                    [pa.array(size.astype(np.int32)), pa.array(np.where(place >= 0, ids[known_place], UNKNOWN).astype(np.int32)), pa.array(value), pa.array(after)], names=["size", "id", "score", "after"]
                )
                ends = pa.ListArray.from_arrays(pa.array(inner), edge)
                own = [c for c in batch.schema.names if c != "edges"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.ListArray.from_arrays(pa.array(outer), ends)], names=[*own, "ends"])

    return run


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def viterbi(ends: Column) -> Column:
    """Sizes and ids of the best path, from the end backwards.  ``ends`` lists
    the edges for each end position; ties go to the path whose last edge is
    longest."""
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("size"), F.lit(0).alias("id")))

    def one(best: Column, here: Column) -> Column:
        def option(edge: Column) -> Column:
            came = F.get(best, F.size(best) - edge["size"])
            open_ = F.getbit(edge["after"], came["size"]) == 1
            return F.when(open_, F.struct((came["score"] + edge["score"]).alias("score"), edge["size"].alias("size"), edge["id"].alias("id")))

        return F.array_append(best, F.array_max(F.transform(here, option)))

    def walk(best: Column) -> Column:
        start = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<struct<at:int,size:int,id:int>>").alias("path"))

        def back(state: Column, i: Column) -> Column:
            edge = F.get(best, i)
            told = F.struct((i - edge["size"]).alias("at"), edge["size"].alias("size"), edge["id"].alias("id"))
            return F.when(state["at"] == i, F.struct((i - edge["size"]).alias("at"), F.array_append(state["path"], told).alias("path"))).otherwise(state)

        return F.aggregate(F.sequence(F.size(best) - 1, F.lit(1), F.lit(-1)), start, back)["path"]

    return _let(F.aggregate(ends, none, one), walk)


def encode_units(units: DataFrame, pieces: DataFrame, fold: str = "merge", longest_piece: int = 16, first_byte: int | None = 3, unknown_id: int = 0, unknown: float = -1e6) -> DataFrame:
    """``units`` of up to ``LONGEST`` characters with their ids (array<int>).

    ``units`` should come dealt by unit (as a grouping leaves them)."""
    spark = units.sparkSession
    table = pieces.select("id", "piece", "score").orderBy("id").toArrow().combine_chunks()  # the vocabulary: a fixed size
    merges = Merges(table) if fold == "merge" else None
    placed = spark.createDataFrame(pa.table({"piece": table["piece"], "place": pa.array(np.arange(len(table)))}))
    shared = spark.sparkContext.broadcast((table, merges))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from follow_batches(*shared.value, unknown)(batches)

    edge = "struct<size:int,id:int,score:double,after:int>"
    found = lattice(units, placed, longest_piece)
    own = [f for f in found.schema.fields if f.name != "edges"]
    told = found.select(*(f.name for f in own), "edges").mapInArrow(follow, T.StructType([*own, T.StructField("ends", T.DataType.fromDDL(f"array<array<{edge}>>"))]))
    path = told.select(*(f.name for f in own), F.reverse(viterbi(F.col("ends"))).alias("path"))

    def spelled(x: Column) -> Column:
        if first_byte is None:
            return F.array(F.lit(unknown_id))
        letter = F.substr("unit", x["at"] + 1, x["size"])
        code = F.hex(F.encode(letter, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.octet_length(letter)), lambda j: (F.conv(F.substr(code, 2 * j - 1, F.lit(2)), 16, 10).cast("int") + first_byte))

    plain = F.transform("path", lambda x: x["id"])
    odd = F.flatten(F.transform("path", lambda x: F.when(x["id"] == UNKNOWN, spelled(x)).otherwise(F.array(x["id"]))))
    return path.select(*(f.name for f in own), F.when(F.exists("path", lambda x: x["id"] == UNKNOWN), odd).otherwise(plain).alias("ids"))


def unit_ids(units: DataFrame, path: str) -> DataFrame:
    """``units``, distinct and dealt by unit, with their ids."""
    own = units.schema.fields

    def by_library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "unit"):
                ids = pa.array([unit_by_library(u, path) for u in batch.column("unit").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    short = encode_units(units.filter(F.length("unit") <= LONGEST), units.sparkSession.createDataFrame(piece_rows(path)))
    long = units.filter(F.length("unit") > LONGEST).mapInArrow(by_library, T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return short.unionByName(long)


def unit_by_library(unit: str, path: str) -> list[int]:
    """Ids of one unit: those of the unit behind a newline, which no piece holds
    beside another character, without what the newline gives."""
    lead = processor(path).encode("\n", num_threads=1)
    return processor(path).encode("\n" + unit.replace(BLANK, " "), num_threads=1)[len(lead) :]


def often_found(docs: DataFrame, path: str, most: int) -> DataFrame:
    """unit, times of the units most often found in a sample of the texts."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = neighbours(path)
        for whole in batches:
            for batch in text_slices(whole, "plain"):
                units, places, _ = text_units(clean_text(batch, "plain"), pairs)
                yield pa.RecordBatch.from_arrays([units.cast(pa.string()), pa.array(np.bincount(places, minlength=len(units)).astype(np.int64))], names=["unit", "times"])

    some = docs if share == 1 else docs.sample(share, seed=9)
    units = some.select("plain").mapInArrow(run, "unit string, times bigint").groupBy("unit").agg(F.sum("times").alias("times"))
    units = materialize(units.filter(F.length("unit") <= HEAD_LENGTH), "pieces-often")
    return units.filter(F.col("times") >= head_threshold(units, most))


@dataclass
class Head:
    """Units that every task knows, the most frequent first: their names, all
    their ids and where each one's start."""

    names: pa.Array
    ids: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, names: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Head:
        names = clean_text(pa.RecordBatch.from_arrays([names], names=["text"]))
        parts = pa.table({"text": names}).to_batches(max_chunksize=NAMES)
        keys = np.concatenate([np.empty(0, np.uint64), *(string_keys(clean_text(p)) for p in parts)])  # some hundred bytes a name while they are made
        order = np.argsort(keys, kind="stable")
        return cls(names, ids, bounds, keys[order], order)

    def find(self, units: pa.Array) -> np.ndarray:
        """The number of each unit in the head, or -1."""
        if not len(units) or not len(self.keys):
            return np.full(len(units), -1)
        units = clean_text(pa.RecordBatch.from_arrays([units], names=["text"]))
        at = self.places[np.minimum(np.searchsorted(self.keys, string_keys(units)), len(self.keys) - 1)]
        same = pc.equal(self.names.take(pa.array(at)), units).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


def make_head(docs: DataFrame, path: str, most: int) -> Head:
    often = often_found(docs, path, most)
    made = unit_ids(often.select("unit").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit"), path)
    found = made.join(often, "unit").toArrow().combine_chunks()  # at most ``most`` rows of up to 64 characters
    if not found.num_rows:
        return Head.of(pa.array([], pa.large_string()), np.empty(0, np.uint32), np.zeros(1, np.int64))
    found = found.sort_by([("times", "descending"), ("unit", "ascending")]).combine_chunks()
    ids = found["ids"].combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
    return Head.of(found["unit"].combine_chunks().cast(pa.large_string()), ids.flatten().to_numpy().astype(np.uint32), bounds)


def _squeeze(raw: bytes) -> bytes:
    packed = pa.compress(raw, "zstd", asbytes=True) if raw else b""
    return packed if len(packed) < len(raw) else raw


def _expand(packed: bytes, size: int, kind: str) -> np.ndarray:
    raw = packed if len(packed) == size else pa.decompress(packed, size, "zstd", asbytes=True)
    return np.frombuffer(raw, kind)


def pack_codes(codes: np.ndarray) -> bytes:
    """Numbers below 2**24: the ``ONE`` most frequent in one byte, the next in
    two, all others in four; first, second and last bytes are compressed apart."""
    rest = codes[codes >= ONE] - ONE
    high = rest >> 8
    first = codes.astype(np.uint8)
    first[codes >= ONE] = np.minimum(high + ONE, 255)
    parts = [_squeeze(x) for x in (first.tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), high[high >= 255 - ONE].astype("<u2").tobytes())]
    return np.array([len(codes), len(parts[0]), len(parts[1])], "<u4").tobytes() + b"".join(parts)


def unpack_codes(packed: bytes) -> np.ndarray:
    n, a, b = np.frombuffer(packed, "<u4", 3).tolist()
    first = _expand(packed[12 : 12 + a], n, "u1").astype(np.int64)
    more = first >= ONE
    high = first[more] - ONE
    low = _expand(packed[12 + a : 12 + a + b], len(high), "u1")
    far = high == 255 - ONE
    high[far] = _expand(packed[12 + a + b :], 2 * int(far.sum()), "<u2")
    first[more] = (high << 8) + low + ONE
    return first


def encode_documents(docs: DataFrame, vocabulary: str | None = None, head_units: int = HEAD_UNITS) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text with blanks), ids and ids_crc32 of
    every row."""
    path = vocabulary or default_path(VOCABULARY)
    spark = docs.sparkSession
    if spark.conf.get(_GROUPS) == "128":  # else lists of edges are sorted and spilled from the 129th unit of a task on
        spark.conf.set(_GROUPS, str(GROUPS))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" "))
    rows = docs.select("doc_id", plain.alias("plain")).withColumns({"h1": F.xxhash64("plain"), "h2": F.hash("plain")})
    shared = spark.sparkContext.broadcast(make_head(rows, path, head_units))
    give_back()  # of the driver's Python

    def coded(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units, their places in the head (or -1) and in order, and the
        units of all texts with where each text starts."""
        found, places, starts = text_units(clean_text(batch, "plain"), neighbours(path))
        return found, shared.value.find(found), places, starts

    def rare_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's units outside the head, sorted."""
        sent: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in text_slices(whole, "plain"):
                fresh = np.zeros(batch.num_rows, bool)  # copies of a text send their units once
                for i, both in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
                    if both not in sent:
                        fresh[i] = True
                        sent.add(both)
                if len(sent) > SENT_TEXTS:
                    sent.clear()
                batch = batch.filter(pa.array(fresh))
                found, at, places, starts = coded(batch)
                order = pc.sort_indices(found.cast(pa.large_binary())).to_numpy().astype(np.int64)
                rank = np.empty(len(found), np.int64)
                rank[order] = np.arange(len(found))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                some = at[places] < 0 if len(places) else np.zeros(0, bool)
                both = np.unique((doc[some] << 32) | rank[places[some]])
                bounds = np.searchsorted(both >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
                units = pa.ListArray.from_arrays(pa.array(bounds), found.take(pa.array(order[both & 0xFFFFFFFF])).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), units], names=["h1", "h2", "units"])

    told = materialize(rows.select("h1", "h2", "plain").mapInArrow(rare_units, "h1 bigint, h2 int, units array<string>"), "pieces-rare")
    missing = told.select("h1", "h2", F.posexplode("units").alias("j", "unit"))
    # units of the head's length are rare; longer ones may be in all texts, and are dealt in parts
    missing = missing.withColumn("part", F.when(F.length("unit") > HEAD_LENGTH, F.pmod("h1", F.lit(PARTS)).cast("int")).otherwise(0))
    # dealt once, by a given number (a partition that is small now holds many edges later); a unit keeps the places it goes to
    dealt = missing.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit", "part")
    made = unit_ids(dealt.groupBy("unit", "part").agg(F.collect_list(F.struct("h1", "h2", "j")).alias("places")), path)
    given = made.select(F.inline("places"), "ids").groupBy("h1", "h2").agg(F.collect_set(F.struct("j", "ids")).alias("given"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes of all places: a head unit's number, or behind those the number
        of a rare unit among the text's own, sorted."""
        for whole in batches:
            for batch in text_slices(whole, "plain"):
                found, at, places, starts = coded(batch)
                rank = np.empty(len(found), np.int64)
                rank[pc.sort_indices(found.cast(pa.large_binary())).to_numpy()] = np.arange(len(found))
                out = []
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    code = at[places[a:b]]
                    left = np.nonzero(code < 0)[0]
                    if len(left):
                        code[left] = len(shared.value.names) + np.unique(rank[places[a:b][left]], return_inverse=True)[1]
                    out.append(pack_codes(code))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(out, pa.binary())], names=["doc_id", "h1", "h2", "packed"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        size, start = np.diff(head.bounds), head.bounds[:-1]
        for batch in batches:
            out, ends, sums = [], [0], []
            given = batch.column("given").to_pylist()
            for packed, own in zip(batch.column("packed").to_pylist(), given, strict=True):
                codes = unpack_codes(packed)
                rare = [g["ids"] for g in sorted(own or [], key=lambda g: g["j"])]
                more = np.array([x for ids in rare for x in ids], np.uint32)
                lengths = np.fromiter(map(len, rare), np.int64, len(rare))
                known = codes < len(size)
                k, r = codes[known], codes[~known] - len(size)
                length, first = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
                length[known], length[~known] = size[k], lengths[r]
                first[known], first[~known] = start[k], len(head.ids) + (np.cumsum(lengths) - lengths)[r]
                bounds = np.concatenate([[0], np.cumsum(length)])
                at = np.repeat(first - bounds[:-1], length) + np.arange(bounds[-1])
                inside = at < len(head.ids)
                ids = np.empty(len(at), "<u4")
                ids[inside], ids[~inside] = head.ids[at[inside]], more[at[~inside] - len(head.ids)]
                out.append(ids)
                ends.append(ends[-1] + len(ids))
                sums.append(zlib.crc32(ids))
            flat = pa.array(np.concatenate([*out, np.empty(0, "<u4")]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), lists, pa.array(sums, pa.int64())], names=["doc_id", "text_hash", "ids", "ids_crc32"])

    packed = rows.mapInArrow(pack, "doc_id bigint, h1 bigint, h2 int, packed binary")
    both = packed.join(given, ["h1", "h2"], "left").select("doc_id", "h1", "packed", "given")
    return both.mapInArrow(assemble, "doc_id bigint, text_hash bigint, ids array<int>, ids_crc32 bigint")


def decode(ids: Column, vocabulary: str | None = None) -> Column:
    """The text of an array of ids: bytes of all pieces joined, without the
    blank put before the text.  Unknown and control ids give nothing."""
    sp = processor(vocabulary or default_path(VOCABULARY))

    def spelled(i: int) -> str:
        if sp.is_byte(i):
            return sp.id_to_piece(i)[3:5]
        return "" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(BLANK, " ").encode().hex()

    table = F.split(F.lit(",".join(spelled(i) for i in range(sp.get_piece_size()))), ",")
    whole = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.when(F.startswith(whole, F.lit(" ")), F.substr(whole, F.lit(2))).otherwise(whole)
