"""Column-at-a-time text helpers on Arrow arrays, used inside Spark's Arrow functions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from demand_engine.session import shared_folder

BATCH_BYTES = 4 << 20  # texts are worked on in slices of about this size, whatever the Arrow batch holds


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()  # workers live on; what the slices needed is not theirs to keep


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.StringArray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: offsets (one more than texts) and all words in order.

    ``lower`` lower-cases A-Z only. A null text has no word.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():  # leading and trailing white space gives empty words
        keep = full.to_numpy(zero_copy_only=False)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        flat = flat.filter(full)
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), flat


def data_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and its offsets into them."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset: strings.offset + len(strings) + 1]
    if strings.buffers()[2] is None or not len(strings):
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each range of ``offsets``; empty ranges give zero."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
