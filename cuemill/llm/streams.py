"""Walking over rows that are already partitioned and sorted by a key, one key at a time.

``groupBy().applyInPandas`` builds a data frame for every group, which costs about a millisecond
each; with many small groups the walk below is far cheaper, because a group is a slice of lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows whose first ``n_keys`` columns are equal; rows come as tuples of all columns."""
    key: tuple | None = None
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield key, rows


def emitter(schema: pa.Schema, size: int = 8192) -> tuple[Callable, Callable]:
    """``add`` takes a row and gives a full batch now and then, ``rest`` gives what is left."""
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        batch = pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)], schema=schema)
        rows.clear()
        return batch

    def add(row: tuple) -> pa.RecordBatch | None:
        rows.append(row)
        return flush() if len(rows) >= size else None

    def rest() -> pa.RecordBatch | None:
        return flush() if rows else None

    return add, rest


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    add, rest = emitter(schema, size)
    for row in rows:
        batch = add(row)
        if batch is not None:
            yield batch
    batch = rest()
    if batch is not None:
        yield batch
