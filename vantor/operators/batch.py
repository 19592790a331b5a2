"""Exact nearest neighbours for a table of queries, in blocks.

Rows and queries are dealt into blocks of bounded size; each pair of a row block and a query block is a cell that one task
scores by matrix products, keeping the first k rows of each query. A last window over the cells' survivors decides. Every
query meets every row exactly once; what a task holds depends on the block sizes only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, UnsupportedMetric

ROW_BLOCK, QUERY_BLOCK, STEP = 50_000, 20_000, 256


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    if (np.diff(offsets) != dims).any():
        raise ValueError("22023: dimension mismatch")
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dims).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "inner_product":
        return -(q @ x.T)
    if metric == "cosine":
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        if not (a.all() and b.all()):
            raise ValueError("22P02: zero vector has no direction")
        return 1.0 - (q @ x.T) / a[:, None] / b[None]
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * (q @ x.T), 0))


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, without the cancellation that a matrix product of large vectors suffers in L2."""
    if metric == "l2":
        return np.sqrt(((q - x) ** 2).sum(1))
    dot = (q * x).sum(1)
    return -dot if metric == "inner_product" else 1.0 - dot / np.sqrt((q * q).sum(1) * (x * x).sum(1))


def batch_nearest(
    rows: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, metric: str = "l2", exclude_self: bool = False, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Rows (query_id, point_id, score, place): for each query the k nearest rows, by score, then point_id.

    Both tables have the columns key (an integer, unique) and vector. Null keys and vectors are left out; vectors of
    another dimension, and vectors of length zero under cosine, are errors. exclude_self drops the row of the query's own key.
    """
    if metric == "l1":
        raise UnsupportedMetric("l1 has no matrix form; use a search per query")
    if metric not in ("l2", "cosine", "inner_product"):
        raise InvalidParameter(f"unknown metric {metric}")
    if k < 1:
        raise InvalidParameter("k must be positive")
    sides = []
    for df, size in ((rows, row_block), (queries, query_block)):
        df = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull())
        sides.append((df, max(1, math.ceil(df.count() / size))))
    (data, n_data), (asked, n_asked) = sides
    data = data.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(n_data)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("j"))
    asked = asked.select("key", "v", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))).alias("i"), F.pmod(F.xxhash64("key"), F.lit(n_asked)).cast("int").alias("j"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names, a, b, s = ["query_id", "point_id", "score"], [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("key")
            x, q, keys, of = _matrix(left["v"], dims), _matrix(right["v"], dims), left["key"].to_numpy(), right["key"].to_numpy()
            for at in range(0, len(q), STEP):
                part = q[at : at + STEP]
                near = _scores(part, x, metric)
                want = min(len(x), k + 8 + exclude_self)  # a few more, as ties are settled by exact scores
                first = np.argpartition(near, want - 1, axis=1)[:, :want] if want < len(x) else np.broadcast_to(np.arange(len(x)), near.shape)
                edge = np.take_along_axis(near, first, 1).max(1)
                for i in range(len(part)):
                    chosen = np.nonzero(near[i] <= edge[i] + 1e-9)[0] if want < len(x) else first[i]
                    if exclude_self:
                        chosen = chosen[keys[chosen] != of[at + i]]
                    exact = _exact(part[i][None], x[chosen], metric)
                    order = np.lexsort((keys[chosen], exact))[:k]
                    a.append(np.full(len(order), of[at + i]))
                    b.append(keys[chosen[order]])
                    s.append(exact[order])
        whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.Table.from_arrays([whole(a, pa.int64()), whole(b, pa.int64()), whole(s, pa.float64())], names)

    cells = data.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(cell, "query_id bigint, point_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "point_id")
    return cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
