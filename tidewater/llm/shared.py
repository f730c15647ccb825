"""Helpers shared by the operators: scratch tables, text batches, word codes.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``.  All text
helpers work on Arrow batches inside tasks and never hold more than a slice of
``SLICE_BYTES`` of text (or one text, if that is longer) at a time.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
_BYTES_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and the master is this machine (tests) a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _test_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_BYTES`` for Python workers, unless the session
    says how large: with Spark's default every worker may be sent 64 MB at once."""
    if spark.conf.get(_BYTES_A_BATCH) == "67108864b":
        spark.conf.set(_BYTES_A_BATCH, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``slice_bytes`` of text each."""
    if batch.num_rows == 0:
        return
    sizes = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + slice_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Free memory of this Python worker goes back to the system: workers live on
    for other tasks, beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def clean_text(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with nulls as empty strings, its bytes starting at 0.

    ``pyarrow.compute.ascii_lower`` gives wrong offsets for arrays whose bytes
    start elsewhere, as those of slices do; so the bytes are laid out anew.
    """
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2] or pa.py_buffer(b"")
    data = data.slice(offsets[0], offsets[-1] - offsets[0])
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets - offsets[0]), data)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words start."""
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    first = offsets[0]
    flat, offsets = flat.slice(first, offsets[-1] - first), offsets - first
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def string_keys(text: pa.Array) -> np.ndarray:
    """A 64-bit key of each string (``large_string`` whose bytes start at 0)."""
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    size = np.diff(offsets)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) if data is not None else np.empty(0, np.uint64)
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat((offsets[:-1] - offsets[0]).astype(np.uint64), size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((place << np.uint64(8)) + raw + np.uint64(1)))])
    return mix(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]] + size.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; spreads small integers over all 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all ``width``-word windows that lie within one text, and
    the place of each window's first word."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.nonzero(np.arange(n) + width <= ends[:n])[0]
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = (key * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]) ^ (key >> np.uint64(29))
    return mix(key[starts]), starts
