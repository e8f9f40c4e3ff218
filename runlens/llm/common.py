"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import cut as cut  # the operators take it from here

# Bytes of one Arrow batch handed to Python: with long texts, rows alone
# do not bound a batch.
BATCH_BYTES = 8 << 20
# Bytes of text that are worked on at a time, where that takes many times
# their size.
PART_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(each):
    """A worker function that gives memory back: Arrow allocates from the
    system, and every few seconds and at the end free pages return to it.
    Workers live on between tasks, and what one keeps the next one lacks."""
    def run(batches):
        import ctypes
        import gc
        import time
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)
        last = time.monotonic()
        for out in each(batches):
            yield out
            if time.monotonic() > last + 2:
                trim(0)
                last = time.monotonic()
        gc.collect()
        trim(0)
    return run


def free_name(taken, base: str) -> str:
    """``base``, or ``base`` with underscores appended until no column of
    ``taken`` has that name (Spark compares without case)."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base += "_"
    return base


def utf8(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets (n+1) and bytes of an Arrow string column, nulls as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, memoryview(data) if data is not None else memoryview(b"")


def parts(column: pa.Array, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column of about ``size`` bytes, one row at least."""
    part = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0)), dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield column.slice(a, b - a)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal ``keys`` out of a sorted stream
    of batches; a group may go over several batches.  Keys are not null."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = np.asarray(batch.column(k))
            change[1:] |= v[1:] != v[:-1]
        if open_ and any(open_[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(open_)
            open_ = []
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if a and open_:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
    if open_:
        yield pa.Table.from_batches(open_)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links
    ``a[i]``-``b[i]`` (hooking on minima with pointer jumping)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        go = ra != rb
        if not go.any():
            break
        a, b, ra, rb = a[go], b[go], ra[go], rb[go]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
