"""Quantization: binary, scalar and product codes, their reconstruction, and training."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter
from vantor.runtime import drawn


def binary_quantize(v: Column) -> Column:
    return F.transform(v, lambda x: x >= 0)


def _levels(low: float, high: float, levels: int) -> None:
    if not 2 <= levels <= 256:
        raise InvalidParameter("levels must be 2 to 256")
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise InvalidParameter("the range must be finite and not empty")


def scalar_quantize(v: Column, low: float, high: float, levels: int = 256) -> Column:
    """Codes 0..levels-1: each value clamped to the range and rounded to the nearest level, halves away from zero."""
    _levels(low, high, levels)
    scale = (levels - 1) / (high - low)
    return F.transform(v, lambda x: F.floor((F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)) - low) * scale + 0.5).cast("int"))


def scalar_reconstruct(codes: Column, low: float, high: float, levels: int = 256) -> Column:
    _levels(low, high, levels)
    step = (high - low) / (levels - 1)
    return F.transform(codes, lambda c: (low + c * step).cast("float"))


Codebooks = Sequence[Sequence[Sequence[float]]]


def _books(width: int, books: Codebooks) -> None:
    if width < 1 or not books or any(not b or len(b) > 256 or any(len(c) != width for c in b) for b in books):
        raise InvalidParameter("each codebook needs 1 to 256 centroids of the subvectors' dimension")


def product_quantize(v: Column, width: int, books: Codebooks) -> Column:
    """Per subvector the number of its nearest centroid by L2, the first of equals."""
    _books(width, books)
    constant = F.array(*(F.array(*(F.array(*(F.lit(float(y)) for y in c)) for c in book)) for book in books))

    def squares(book: Column, i: Column) -> Column:
        part = F.slice(v, i * width + 1, width)
        return F.transform(book, lambda c: F.aggregate(F.zip_with(part, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))

    codes = F.transform(F.transform(constant, squares), lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))
    good = F.size(v) == width * len(books)
    return F.when(good, codes).when(good.isNotNull(), F.raise_error(F.lit("22023: dimension mismatch")).cast("array<int>"))


def product_reconstruct(codes: Column, width: int, books: Codebooks) -> Column:
    _books(width, books)
    constant = F.array(*(F.array(*(F.array(*(F.lit(float(y)) for y in c)) for c in book)) for book in books))
    return F.flatten(F.zip_with(constant, codes, lambda book, c: F.element_at(book, c + 1))).cast("array<float>")


def train_scalar(df: DataFrame, vector: str) -> tuple[float, float]:
    """The least and greatest value in the column; a constant column's range is widened by one float step."""
    r = df.select(F.array_min(vector).alias("a"), F.array_max(vector).alias("b")).agg(F.min("a"), F.max("b")).first()
    if r[0] is None:
        raise InvalidParameter("nothing to train on")
    low, high = float(r[0]), float(r[1])
    return (low, float(np.nextafter(np.float32(high), np.float32(np.inf)))) if low == high else (low, high)


def train_product(df: DataFrame, vector: str, key: str, width: int, centroids: int, rounds: int = 8, sample: int = 16_384) -> list[list[list[float]]]:
    """Codebooks by Lloyd's algorithm, per subvector; seeds are evenly spaced, an empty cell keeps its centroid.

    Trained on at most `sample` rows, those with the smallest hash of the key, in the order of the key.
    """
    if not 1 <= centroids <= 256:
        raise InvalidParameter("1 to 256 centroids")
    usable = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    taken = drawn(usable, F.xxhash64(key), sample, usable.count()).collect()
    rows = np.array([r[1] for r in sorted(taken, key=lambda r: r[0])], np.float64)
    if not len(rows) or rows.shape[1] % width:
        raise InvalidParameter("no rows, or the dimension isn't a multiple of the subvectors'")
    books = []
    for at in range(0, rows.shape[1], width):
        x = rows[:, at : at + width]
        k = min(centroids, len(x))
        c = x[[i * len(x) // k for i in range(k)]].copy()
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            for j in range(k):
                if (near == j).any():
                    c[j] = x[near == j].mean(0)
        books.append(c.astype(np.float32).astype(float).tolist())
    return books
