"""Token ids in Parquet: one list of ids a document, in ascending id order.

Layout.  Documents are dealt out by ranges of ids, so that file ``k`` holds ids
below those of file ``k + 1``, and sorted inside a file.  Columns: the id, the
shard, ``start_in_shard`` (ids before the document in its shard), ``n_tokens``
and the list column ``tokens``.  Ids are dictionary encoded (bit-packed codes),
or delta encoded (``encoding="delta"``); row groups and pages are kept small
and carry column and offset indexes, so a reader of some documents opens only
their pages (``read_some``) and a reader of metadata opens no ids
(``read_metadata``).

Texts are encoded where they are read; only packed ids (two bytes each where
the vocabulary allows) are shuffled.

Defined cases: a null text counts as empty and holds the end id only; null ids
sort first; repeated ids stay, in the order of their packed ids; an empty table
gives a readable table without rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.encode import ENCODE_BYTES, default_path, encoder, tokenizer
from tidewater.llm.shared import clean_text, text_slices

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 512
SCHEMA = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, tokens array<int>"


def range_ends(docs: DataFrame, shards: int) -> np.ndarray:
    """The largest id of each shard but the last, from one scan of the ids."""
    shares = [k / shards for k in range(1, shards)]
    ends = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * shards)).first()[0] if shares else None
    return np.array(ends or [], np.int64)


def encode_batches(path: str, end_id: int | None, ends: np.ndarray):
    """For ``mapInArrow`` over (doc_id, text): shard and packed ids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = packed_type(path)
        for whole in batches:
            for batch in text_slices(whole, slice_bytes=ENCODE_BYTES):
                ids, bounds = encoder(path).encode(clean_text(batch), end_id)
                raw = pa.py_buffer(ids.astype(dtype))
                packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * np.dtype(dtype).itemsize), raw])
                name = batch.column("doc_id")
                shard = np.searchsorted(ends, pc.fill_null(name, np.iinfo(np.int64).min).to_numpy())
                yield pa.RecordBatch.from_arrays([name, pa.array(shard.astype(np.int32)), packed.cast(pa.binary())], names=["doc_id", "shard", "packed"])

    return run


def packed_type(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def list_batches(path: str):
    """For ``mapInArrow`` over sorted (doc_id, shard, packed): rows of ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(packed_type(path))
        done: dict[int, int] = {}
        for batch in batches:
            packed = batch.column("packed")
            offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4) // dtype.itemsize
            ids = np.frombuffer(packed.buffers()[2] or b"", dtype)[offsets[0] : offsets[-1]]
            bounds = offsets.astype(np.int64) - offsets[0]
            shard, counts = batch.column("shard").to_numpy(), np.diff(bounds)
            start = np.empty(len(counts), np.int64)
            for k in np.unique(shard):
                at = np.nonzero(shard == k)[0]
                start[at] = done.get(k, 0) + np.cumsum(counts[at]) - counts[at]
                done[k] = done.get(k, 0) + int(counts[at].sum())
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), pa.array(start), pa.array(counts), tokens], names=["doc_id", "shard", "start_in_shard", "n_tokens", "tokens"])

    return run


def write_tokens(
    docs: DataFrame,
    out: str,
    *,
    shards: int,
    vocabulary: str | None = None,
    end_id: int | None = END_ID,
    encoding: str = "dictionary",
) -> None:
    """Write (doc_id, text) rows to ``out``, in ascending doc_id order."""
    path = vocabulary or default_path(VOCABULARY)
    ends = range_ends(docs, shards)
    packed = docs.select("doc_id", "text").mapInArrow(encode_batches(path, end_id, ends), "doc_id bigint, shard int, packed binary")
    ordered = packed.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "packed")
    rows = ordered.mapInArrow(list_batches(path), SCHEMA)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.page.write-checksum.enabled", "true")
        .parquet(out)
    )


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, shard, start_in_shard, n_tokens: no ids are read."""
    return spark.read.schema(SCHEMA).parquet(out).drop("tokens")


def read_some(spark: SparkSession, out: str, least: int, most: int) -> DataFrame:
    """The rows with ``least <= doc_id <= most``: the filter reaches the scan, so
    footers and page indexes leave out other files, row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(out).filter(F.col("doc_id").between(least, most))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The rows of ``out`` with ``start``: ids of all documents before each.

    The shards' totals are one row a shard; only those are summed in order.
    """
    rows = spark.read.schema(SCHEMA).parquet(out)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).collect()
    start, starts = 0, []
    for shard, total in sorted(totals):
        starts.append((shard, start))
        start += total
    starts = spark.createDataFrame(starts, "shard int, shard_start bigint")
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("start_in_shard"))


def crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, tokens) to the digest of the ids read."""
    for batch in batches:
        tokens = batch.column("tokens")
        bounds = tokens.offsets.to_numpy()
        raw = tokens.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        arrays = [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        crc_batches, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def decode_tokens(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) back from ids, by the vocabulary's own decoder."""
    path = vocabulary or default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(path).tokenizer.decode(ids or []) for ids in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")
