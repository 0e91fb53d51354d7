"""Nodes that run as numpy on Arrow batches: they return one array column.

A kernel carries its parameters; Spark broadcasts it to the executors once it is larger than a megabyte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import BadShape
from ..functions.values import no_nan
from .registry import Value

#: Rows that a kernel works on at once, so that its intermediates stay in cache.
BLOCK = 4096


def block(columns: tuple[pa.Array, ...]) -> np.ndarray:
    """The columns as one matrix of doubles, NaN for NULL."""
    out = np.empty((len(columns[0]), len(columns)))
    for i, c in enumerate(columns):
        out[:, i] = c.to_numpy(zero_copy_only=False)
    return out


def kernel(spark: SparkSession | None, run: Callable[..., np.ndarray], cols: list[Column], width: int, arrays: bool = False) -> list[Column]:
    """run's columns: it gets a matrix of the input columns (or, with arrays, each Arrow array) and returns [rows, width]."""
    @F.arrow_udf("array<double>")
    def call(*columns: pa.Array) -> pa.Array:
        if arrays:
            out = run(*columns)
        else:
            x = block(columns)
            out = np.empty((len(x), width))
            for at in range(0, len(x), BLOCK):
                out[at : at + BLOCK] = run(x[at : at + BLOCK])
        flat = pa.array(np.ascontiguousarray(out, dtype=float).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), flat)

    made = call(*cols)
    return [no_nan(F.get(made, F.lit(k))) for k in range(width)]


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the index and the value of each entry of a column of maps, row by row; NaN for NULL."""
    ends = column.offsets.to_numpy(zero_copy_only=False)
    there = slice(int(ends[0]), int(ends[-1]))
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.keys.to_numpy(zero_copy_only=False)[there], column.items.to_numpy(zero_copy_only=False)[there].astype(float)


def sparse_dot(spark: SparkSession | None, value: Value, weights: np.ndarray) -> list[Column]:
    """A sparse value times each row of weights; what it doesn't hold is zero.

    A normalised one is divided after its sums, so that they are rounded once; only a row whose sums overflow is divided before.
    """
    weights = np.ascontiguousarray(weights, dtype=float)
    if weights.shape[1] != value.size:
        raise BadShape(f"{weights.shape[1]} weights are given for {value.size} features")
    divisors = value.divisors

    def sums(n: int, rows: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(rows, w[at] * x, n) for w in weights], axis=1)

    def run(column: pa.Array) -> np.ndarray:
        n, (rows, at, x) = len(column), entries(column)
        out = sums(n, rows, at, x)
        if divisors is None:
            return out
        by = divisors(n, rows, x)
        over = ~np.isfinite(out).all(axis=1)
        out = out / by[:, None]
        if over.any():
            out[over] = sums(n, rows, at, x / by[rows])[over]
        return out

    return kernel(spark, run, value.cols if divisors is None else [value.whole], len(weights), arrays=True)


def sparse_map(value: Value, run: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Value:
    """The sparse value with other numbers at its places: run gets the number of rows, and each entry's row, index and value."""

    @F.arrow_udf("map<int,double>")
    def call(column: pa.Array) -> pa.Array:
        rows, at, x = entries(column)
        ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(column))))).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(ends), pa.array(at, pa.int32()), pa.array(run(len(column), rows, at, x)))

    return Value([call(value.cols[0])], "map", size=value.size)
