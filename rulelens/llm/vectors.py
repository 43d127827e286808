"""Vectors as rows of whole numbers, for operators that must be exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rulelens.llm.common import by_batch, saved

SCALE = 1024
WIDEST = 1 << 31  # whole components are kept in 32 bits, beyond that in 64 where an operator allows it


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))


def length(vectors: DataFrame, vector: str = "embedding") -> int:
    """Components of the longest vector; 0 for no vectors."""
    return vectors.agg(F.max(F.size(vector))).first()[0] or 0


def kind(vectors: DataFrame, vector: str = "embedding") -> type:
    """The whole-number type that holds 1024 times every component."""
    most = vectors.agg(F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    return np.int32 if most * SCALE + 1 < WIDEST else np.int64


def whole_rows(column: pa.ListArray, d: int, dtype: type = np.int32) -> np.ndarray:
    """floor(1024 * x) of every component, a row a vector; vectors of fewer than ``d`` components are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    bits = 8 * np.dtype(dtype).itemsize
    if len(flat) and np.abs(flat).max() >= 1 << (bits - 1):
        raise ValueError(f"a component times 1024 does not fit in {bits} bits")
    out = np.zeros((len(column), d), dtype=dtype)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def whole(vectors: DataFrame, d: int, also: tuple[str, ...] = (), vector: str = "embedding", dtype: type = np.int32) -> DataFrame:
    """row (a number of its own for every row), vec_id, the columns ``also``, data (``d`` whole numbers of ``dtype``) and top (the largest
    absolute component) of all usable vectors, as a written table, so that the numbers stay when a task is run again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = whole_rows(b.column("vector"), d, dtype)
            data = pa.array([r.tobytes() for r in rows], pa.binary())
            top = np.abs(rows.astype(np.int64)).max(axis=1, initial=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows))), *[b.column(c) for c in ("vec_id", *also)], data, pa.array(top)], ["row", "vec_id", *also, "data", "top"])
            at += len(rows)

    rows = usable(vectors, vector).select(F.col("vec_id").cast("long").alias("vec_id"), *also, F.col(vector).alias("vector"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in also)
    return saved(by_batch(rows, build, f"row long, vec_id long, {kinds}data binary, top long"), "whole-vectors")


def matrix(data: pa.Array | list[bytes], d: int, dtype: type = np.int32) -> np.ndarray:
    """The rows of a data column."""
    values = data.to_pylist() if isinstance(data, (pa.Array, pa.ChunkedArray)) else data
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), d)
