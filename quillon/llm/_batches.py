"""Shared helpers: Arrow text batches as numpy byte arrays, word spans and hashes, and tables in the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.functions.shared import shared_folder  # noqa: F401

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_PER_BATCH = 1000
BYTES_PER_SLICE = 1 << 20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for the bytes of `[^\x20\x09-\x0D]+`.
SPACED_WORD = np.ones(256, dtype=bool)
SPACED_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: True for the bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
PLAIN_WORD = np.zeros(256, dtype=bool)
PLAIN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most ROWS_PER_BATCH rows at a time for the rest of the session; only registered queries and stages call this.

    Spark's own limit of bytes per batch holds anyway; operators that run their work themselves lower the rows meanwhile.
    """
    spark.conf.set(BATCH_SETTING, str(ROWS_PER_BATCH))


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> Iterator[None]:
    """The same for a while; the session gets its own setting back."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_caches: dict[str, Callable[[], None]] = {}


def holds_cache(name: str, clear: Callable[[], None] | None = None) -> None:
    """Say in a task whose cache is used from now on; Python workers outlive stages, so the caches of other operators are let go."""
    # what a batch has taken goes back at once, not to a pool that keeps it
    pa.set_memory_pool(pa.system_memory_pool())
    others = [k for k in _caches if k != name]
    for k in others:
        _caches.pop(k)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if clear is not None:
        _caches[name] = clear


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete a query's shuffle files as soon as it has ended, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP_SETTING)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path: cuts the lineage, survives the loss of executors, and leaves no shuffle files behind."""
    with smaller_batches(df.sparkSession), shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about BYTES_PER_SLICE of text; NULL text has no bytes."""
    text = batch.column(column)
    if text.null_count:
        text = text.fill_null("")
    wide = text.type in (pa.large_string(), pa.large_binary())
    at = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BYTES_PER_SLICE, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of bytes in `inside`, never across rows; row r has the words first[r]:first[r + 1]."""
    mask = inside[data]
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | edge[1:-1]
    ends = mask
    ends[:-1] &= ~mask[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _M1
    at, live = 0, np.arange(len(starts))
    while len(live):
        left = size[live] - at
        v = eights[starts[live] + at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ v) + _M1)
        at += 8
        live = live[left > 8]
    return h
