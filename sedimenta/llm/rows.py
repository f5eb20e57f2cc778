"""Row-wise use of an operator inside a table: filters and rewrites that keep all other columns and need no join."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_held: dict[str, tuple[object, object]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(keep: str = "") -> None:
    """What a Python worker does as a task begins: Spark reuses workers, so tables of other operators and freed memory go back to the system."""
    for name in [n for n in _held if n != keep]:
        del _held[name]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def held_by_worker(name: str, version: object, build: Callable[[], object]) -> object:
    """A large read-only object that the tasks of one operator share in a worker; another version of it takes its place."""
    tidy(name)
    if name not in _held or _held[name][0] != version:
        _held.pop(name, None)
        _held[name] = (version, build())
    return _held[name][1]


def filter_rows(docs: DataFrame, column: str, keep: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows for whose value of a column `keep` says so; it gets a batch of values at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(column))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rewrite_column(docs: DataFrame, column: str, change: Callable[[], Callable[[str], str]]) -> DataFrame:
    """All rows, with the values of a string column changed; nulls stay. `change` makes the function once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        one = change()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            new = pa.array([one(v.as_py()) if v.is_valid else None for v in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.withColumn(column, F.col(column).cast("string")).mapInArrow(run, docs.schema)
