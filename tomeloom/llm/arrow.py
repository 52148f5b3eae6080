"""Reading Arrow batches row by row, and giving rows back in bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows, and about the bytes, after which a batch is given back.
ROWS, BYTES = 4096, 8 << 20
#: Bytes of a batch that Spark sends to a worker, where small_batches() was asked for.
SENT_BYTES = 4 << 20
#: What a worker process keeps from one task for the next of the same operator; release() empties it.
kept: dict = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def rows_of(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows as tuples; at most ``step`` of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, step).columns], strict=True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of about SENT_BYTES: else 10,000 rows or 64 MB
    are one, and stand several times in an executor's memory, beside its heap, and in the worker's."""
    spark.conf.set(_BATCH, str(SENT_BYTES))


def release() -> None:
    """Gives what was freed back to the system: allocators keep it, and Python workers outlive their tasks."""
    kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, after which its worker holds no more than before, nor what another operator's tasks kept."""

    def then_release(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return then_release


class Sink:
    """Collects rows of a schema into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, nbytes: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += nbytes
        if len(self.rows) >= ROWS or self.bytes >= BYTES:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.schema.types, strict=True)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def mapped(schema: pa.Schema, row: Callable[[tuple], Iterable[tuple]], size: Callable[[tuple], int] = lambda r: 64) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one that maps a row to rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        for r in rows_of(batches):
            for out in row(r):
                yield from sink.add(out, size(out))
        yield from sink.end()

    return run
