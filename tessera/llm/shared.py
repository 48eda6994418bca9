"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera import lineage
from tessera.lineage import discard, release, scratch_dir, ship

__all__ = ["cut", "discard", "flat_bytes", "kept", "map_arrow", "read", "release", "scratch_dir", "ship", "slices", "steps"]

#: Bytes of an Arrow batch, unless the session names its own bound: executors hold a batch in Python and twice outside the heap.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20

_open: list[list[DataFrame]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """``lineage.cut``; the table goes when the ``steps`` around it end."""
    table = lineage.cut(df, name)
    for made in _open:
        made.append(table)
    return table


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are cut inside, but for those that the given function has marked to stay."""
    made: list[DataFrame] = []
    stay: list[DataFrame] = []
    _open.append(made)
    try:
        yield lambda table: stay.append(table) or table
    finally:
        # by identity: lists of frames do not compare
        _open[:] = [m for m in _open if m is not made]
        for table in made:
            if not any(table is s for s in stay):
                discard(table)
        release(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidy() -> None:
    """Give memory that a task has freed back to the system: workers stay alive between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_kept: dict[str, object] = {}
_stage = ""


def kept(name: str, make: Callable[[], object]):
    """What a task of ``map_arrow`` leaves in its worker for the next task of the same map; another map's task drops it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def begin(stage: str) -> None:
    global _stage
    if stage != _stage:
        _stage = stage
        if _kept:
            _kept.clear()
            tidy()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``; the package goes to the executors first, and a task that ends leaves no memory behind.

    Sets the session's bound of an Arrow batch to ``BATCH_BYTES`` where the session has not set one.
    """
    ship(df.sparkSession)
    if BATCH not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    stage = uuid.uuid4().hex

    def task(batches):
        begin(stage)
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``max_bytes`` of ``column``, one row at least (a long text stays whole)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(values: pa.Array):
    """The bytes of a string or binary array as one uint8 array, with the n + 1 offsets of its rows; null counts as empty."""
    import numpy as np

    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]
