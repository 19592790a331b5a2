"""Scores of a vector column against constant queries, computed over Arrow batches.

One function per search gives each row's score in one pass, in double precision, whatever the dimension: nothing is
written out, so that no stage outgrows the code generator, and the planner handles one expression. Equal vectors get
equal scores, as each row is added up by itself in one order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, UnsupportedMetric
from vantor.functions.vectors import METRICS, check_vector

#: Values that are widened to double precision at a time.
STEP = 1 << 20
#: Score that stands for a vector of length zero under cosine, which no distance can be.
NO_DIRECTION = float("-inf")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(valid, offsets, values, rows' values that are null) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    missing = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    return valid, column.offsets.to_numpy(), values.to_numpy(zero_copy_only=False), missing


def matrices(column: pa.Array, dims: int):
    """Yields (positions, vectors in double precision) of the vectors of that dimension without null values, a bounded number at a time."""
    valid, offsets, values, missing = _flat(column)
    at = np.nonzero(valid & (np.diff(offsets) == dims))[0]
    step = max(1, STEP // dims)
    for i in range(0, len(at), step):
        part = at[i : i + step]
        places = offsets[part][:, None] + np.arange(dims)
        if missing is not None:
            whole = ~missing[places].any(1)
            part, places = part[whole], places[whole]
        yield part, values[places].astype(np.float64)


def scores_of(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The metric's score of each row of x, the lower the better."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            return np.sqrt(np.einsum("ij,ij->i", d := x - q, d))
        if metric == "l1":
            return np.abs(x - q).sum(1)
        dot = np.einsum("ij,j->i", x, q)
        if metric == "inner_product":
            return -dot
        norms = np.einsum("ij,ij->i", x, x) * np.einsum("j,j->", q, q)
        return np.where(norms == 0, NO_DIRECTION, 1.0 - dot / np.sqrt(norms))


def check_metric(metric: str) -> str:
    if metric in ("hamming", "jaccard"):
        raise UnsupportedMetric(f"{metric} isn't a metric of numeric vectors here")
    if metric not in METRICS:
        raise InvalidParameter(f"unknown metric {metric}")
    return metric


def score(metric: str, column: Column, query: Sequence[float]) -> Column:
    """The score of each vector; null for null ones, other dimensions and null values, NO_DIRECTION for length zero under cosine."""
    check_metric(metric)
    q = np.array(check_vector(query))

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        out, there = np.zeros(len(column)), np.zeros(len(column), bool)
        for at, x in matrices(column, len(q)):
            out[at], there[at] = scores_of(metric, x, q), True
        return pa.array(out, pa.float64(), mask=~there)

    return run(column)


def products(column: Column, queries: Sequence[Sequence[float]]) -> Column:
    """The inner products of each vector with all queries, as an array; null for null vectors; another dimension is an error (22023)."""
    q = np.array([check_vector(x) for x in queries])

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        valid, offsets, _, _ = _flat(column)
        if (np.diff(offsets)[valid] != q.shape[1]).any():
            raise ValueError("22023: dimension mismatch")
        out, there = np.zeros((len(column), len(q))), np.zeros(len(column), bool)
        with np.errstate(all="ignore"):
            for at, x in matrices(column, q.shape[1]):
                out[at] = np.einsum("ij,kj->ik", x, q)
                there[at] = True
        ends = np.arange(len(column) + 1, dtype=np.int32) * len(q)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~there))

    return run(column)


def best_products(tokens: Column, queries: Sequence[Sequence[float]]) -> Column:
    """Per array of token vectors, the sum over the queries of the best inner product with any token; no tokens and other dimensions are errors (22023)."""
    q = np.array([check_vector(x) for x in queries])

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = column.offsets.to_numpy()
        if column.null_count or (np.diff(offsets) < 1).any():
            raise ValueError("22023: a row has no tokens")
        if not len(column):
            return pa.array([], pa.float64())
        tokens = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        valid, inner, _, missing = _flat(tokens)
        if not valid.all() or missing is not None or (np.diff(inner) != q.shape[1]).any():
            raise ValueError("22023: dimension mismatch")
        total, starts = np.empty((len(tokens), len(q))), offsets[:-1] - offsets[0]
        with np.errstate(all="ignore"):
            for at, x in matrices(tokens, q.shape[1]):
                total[at] = np.einsum("ij,kj->ik", x, q)
        return pa.array(np.maximum.reduceat(total, starts, axis=0).sum(1))

    return run(tokens)
