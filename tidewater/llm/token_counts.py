"""Token counts of whole texts without making ids for every text.

A text is cut into units: a space starts a new unit where the character before
it isn't white space, so a unit holds whole pre-tokens and the tokens of a text
are those of its units.  Every distinct unit of the corpus is counted once.
Units found often (as many as ``HEAD_UNITS`` at most, a fixed bound) are sent to
all tasks; a document's other units are joined to the table of units on the
unit itself.  Texts in which some white space precedes a cut are cut by the
vocabulary's own rule as one unit of their own, so the sum is exact for all.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
and ids stay apart, each with its own count; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.encode import default_path, tokenizer
from tidewater.llm.shared import clean_text, materialize, text_slices

VOCABULARY = "byte_bpe_50k.json"
HEAD_UNITS = 1 << 19


def text_units(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the unit of each place and where each text starts."""
    lists = pc.split_pattern(text, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    parts, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    blank = pc.or_(pc.equal(pc.binary_length(parts), 0), pc.match_substring_regex(parts, r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]$")).to_numpy(zero_copy_only=False)
    n = len(text)
    filled = np.diff(offsets)
    lead = np.ones(len(codes), bool)  # with a space before it
    lead[offsets[:-1][filled > 0]] = False
    # a blank part spoils its text unless it is the last one, with nothing behind it
    spoils = blank[codes] if len(codes) else np.zeros(0, bool)
    last = np.zeros(len(codes), bool)
    last[offsets[1:][filled > 0] - 1] = True
    spoils &= ~(last & ~(lead & (pc.equal(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)[codes] if len(codes) else lead)))
    spoiled = np.zeros(n, bool)
    spoiled[np.repeat(np.arange(n), filled)[spoils]] = True
    # distinct units: part with and without its space, then spoiled texts whole
    keep = ~np.repeat(spoiled, filled)
    both = codes * 2 + lead
    used, place = np.unique(both[keep], return_inverse=True)
    words = parts.take(pa.array(used >> 1))
    spaces = pa.array(np.where(used & 1, " ", ""), words.type)
    units = pc.binary_join_element_wise(spaces, words, pa.scalar("", words.type))
    kept = np.where(spoiled, 1, filled)
    starts = np.concatenate([[0], np.cumsum(kept)])
    out = np.empty(starts[-1], np.int64)
    is_whole = np.zeros(starts[-1], bool)
    is_whole[starts[:-1][spoiled]] = True
    out[~is_whole] = place
    out[is_whole] = len(units) + np.arange(int(spoiled.sum()))
    units = pa.concat_arrays([units, text.filter(pa.array(spoiled)).cast(units.type)])
    return units, out, starts


def unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            units, places, _ = text_units(clean_text(batch))
            times = np.bincount(places, minlength=len(units))
            yield pa.RecordBatch.from_arrays([units.cast(pa.string()), pa.array(times)], names=["unit", "times"])


def count_batches(path: str):
    """(unit, times) with ``pieces``, by the vocabulary's library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "unit"):
                found = tokenizer(path).encode_batch_fast(batch.column("unit").to_pylist(), add_special_tokens=False)
                pieces = np.fromiter(map(len, found), np.int64, len(found))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces)], names=["unit", "times", "pieces"])

    return run


def unit_table(docs: DataFrame, path: str) -> DataFrame:
    """unit, times, pieces: one row for each distinct unit of all texts."""
    seen = docs.select("text").mapInArrow(unit_batches, "unit string, times bigint")
    units = seen.groupBy("unit").agg(F.sum("times").alias("times"))
    return materialize(units.mapInArrow(count_batches(path), "unit string, times bigint, pieces bigint"), "units")


def head_threshold(units: DataFrame, most: int) -> int:
    """The least number of times such that at most ``most`` units have it."""
    by_size = units.groupBy(F.least(F.col("times"), F.lit(1_000_000)).alias("t")).count()
    rows = sorted(by_size.collect(), reverse=True)
    total = 0
    for row in rows:
        total += row["count"]
        if total > most:
            return row["t"] + 1
    return 1


def summed(docs: DataFrame, units: DataFrame, head_units: int = HEAD_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens from texts and the table of units."""
    spark = docs.sparkSession
    floor = head_threshold(units, head_units)
    # at most HEAD_UNITS short rows: units of over 64 characters stay in the join
    head = units.filter((F.col("times") >= floor) & (F.length("unit") <= 64)).select("unit", "pieces").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((head["unit"].combine_chunks().cast(pa.large_string()), head["pieces"].to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = shared.value
        for whole in batches:
            for batch in text_slices(whole):
                text = clean_text(batch)
                found, places, starts = text_units(text)
                at = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)
                count = np.where(at >= 0, pieces[at], 0) if len(pieces) else np.zeros(len(at), np.int64)
                total = np.concatenate([[0], np.cumsum(count[places])])
                rare = np.nonzero((at < 0)[places])[0]
                doc = np.repeat(np.arange(len(text)), np.diff(starts))[rare]
                pairs, times = np.unique((doc << 32) | places[rare], return_counts=True)
                bounds = np.searchsorted(pairs >> 32, np.arange(len(text) + 1))
                struct = pa.StructArray.from_arrays([found.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string()), pa.array(times.astype(np.int64))], names=["unit", "freq"])
                arrays = [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pc.binary_length(text).cast(pa.int64()),
                    pa.array(total[starts[1:]] - total[starts[:-1]]),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), struct),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_bytes", "common", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row bigint, doc_id bigint, n_bytes bigint, common bigint, rare array<struct<unit:string,freq:bigint>>"
    base = materialize(rows.mapInArrow(run, schema), "counted")
    rare = base.select("row", F.inline("rare")).join(units.select("unit", "pieces"), "unit")
    rest = rare.groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("rest"))
    total = F.col("common") + F.coalesce("rest", F.lit(0))
    return base.select("row", "doc_id", "n_bytes", "common").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, head_units: int = HEAD_UNITS) -> DataFrame:
    units = unit_table(docs, vocabulary or default_path(VOCABULARY))
    return summed(docs, units, head_units)
