"""Dense vectors: distances, comparison, text form and conversions, as expressions that stay in the JVM.

A dense vector is an array of float (or double). Distances compute in double precision and are null if an operand is
null. They are higher-order functions, so that their code is small whatever the dimension. Searches against a
constant query use the Arrow batch functions of `scoring`, which are faster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, InvalidVector, OutOfRange, UnsupportedMetric

MAX_DIMENSIONS = 16_000
Vector = Sequence[float] | Column
METRICS = ("l2", "inner_product", "cosine", "l1")


def check_vector(values: Sequence[float], dims: int | None = None) -> list[float]:
    """A constant vector's values as floats; it must be finite, not empty, of at most MAX_DIMENSIONS and of the given dimension."""
    out = [float(x) for x in values]
    if not out or len(out) > MAX_DIMENSIONS:
        raise InvalidVector(f"a vector has 1 to {MAX_DIMENSIONS} dimensions, not {len(out)}")
    if not all(math.isfinite(x) for x in out):
        raise InvalidVector("a vector's values must be finite")
    if dims is not None and len(out) != dims:
        raise InvalidParameter(f"expected {dims} dimensions, not {len(out)}")
    return out


def error(message: str | Column, kind: str = "double") -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message).cast(kind)


def constant(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _column(v: Vector) -> Column:
    return v if isinstance(v, Column) else constant(check_vector(v))


def _fold(a: Vector, b: Vector, term: Callable[[Column, Column], Column]) -> Column:
    """The sum of term over the dimensions of both; the dimensions must agree."""
    a, b = _column(a), _column(b)
    same = F.size(a) == F.size(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(same, total).when(same.isNotNull(), error("22023: dimension mismatch"))


def inner_product(a: Vector, b: Vector) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def negative_inner_product(a: Vector, b: Vector) -> Column:
    return -inner_product(a, b)


def l2_distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Vector, b: Vector) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def squared_norm(a: Vector) -> Column:
    if not isinstance(a, Column):
        return F.lit(sum(x * x for x in check_vector(a)))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine_distance(a: Vector, b: Vector) -> Column:
    """1 - cosine; an operand of length zero is an error."""
    if not isinstance(a, Column) and isinstance(b, Column):
        a, b = b, a
    norms = squared_norm(a) * squared_norm(b)
    return F.when(norms > 0, 1.0 - inner_product(a, b) / F.sqrt(norms)).when(norms.isNotNull(), error("22P02: zero vector has no direction"))


def distance(metric: str, a: Vector, b: Vector) -> Column:
    """The metric's score, the lower the better; inner_product means the negative one."""
    known = {"l2": l2_distance, "inner_product": negative_inner_product, "cosine": cosine_distance, "l1": l1_distance}
    if metric in ("hamming", "jaccard"):
        raise UnsupportedMetric(f"{metric} isn't a metric of numeric vectors here")
    if metric not in known:
        raise InvalidParameter(f"unknown metric {metric}")
    return known[metric](a, b)


def binary_distance(metric: str, a: Column, b: Column) -> Column:
    """hamming or jaccard of numeric vectors whose values are all 0 or 1; others are an error."""
    plain = F.forall(a, lambda x: (x == 0) | (x == 1)) & F.forall(b, lambda x: (x == 0) | (x == 1))
    if metric == "hamming":
        value = _fold(a, b, lambda x, y: F.abs(x - y))
    elif metric == "jaccard":
        union = _fold(a, b, lambda x, y: F.greatest(x, y))
        value = F.when(union == 0, 0.0).otherwise(1.0 - _fold(a, b, lambda x, y: x * y) / union)
    else:
        raise InvalidParameter(f"unknown metric {metric}")
    return F.when(plain, value).when(plain.isNotNull(), error("22023: binary metrics need values 0 and 1"))


def dims(v: Column) -> Column:
    return F.size(v)


def enforce_dims(v: Column, n: int) -> Column:
    """v; another dimension than n is an error."""
    if not 1 <= n <= MAX_DIMENSIONS:
        raise InvalidParameter(f"a vector has 1 to {MAX_DIMENSIONS} dimensions")
    return F.when(F.size(v) == n, v).when(v.isNotNull(), error(f"22023: expected {n} dimensions", "array<float>"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by values from the first on, then the shorter first."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def parse(text: Column) -> Column:
    """A vector from its text form, as in [1,2.5,-3]; malformed text and values that aren't finite floats are errors."""
    good = F.trim(text).rlike(rf"^\[\s*{_NUMBER}(?:\s*,\s*{_NUMBER})*\s*\]$")
    values = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))
    finite = F.forall(values, lambda x: F.abs(x) < float("inf")) & (F.size(values) <= MAX_DIMENSIONS)
    bad = error("22P02: malformed vector", "array<float>")
    return F.when(good, F.when(finite, values).otherwise(bad)).when(good.isNotNull(), bad)


def _plain(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def to_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, _plain), ","), F.lit("]"))


def from_real_array(v: Column) -> Column:
    """A vector from array<float>; null, non-finite or no values are errors."""
    good = (F.size(v) > 0) & (F.size(v) <= MAX_DIMENSIONS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, v.cast("array<float>")).when(v.isNotNull(), error("22P02: a vector needs finite values", "array<float>"))


def from_exact_array(v: Column) -> Column:
    """A vector from array<int> or array<double>; a value that float can't hold exactly is an error (22003)."""
    exact = F.forall(v, lambda x: x.cast("float").cast("double") == x.cast("double"))
    return F.when(exact, from_real_array(v.cast("array<float>"))).when(v.isNotNull(), error("22003: value isn't exactly a float", "array<float>"))


def to_real_array(v: Column) -> Column:
    return v.cast("array<float>")


def exact_float(values: Sequence[float]) -> list[float]:
    """Driver-side twin of from_exact_array."""
    import struct

    out = check_vector(values)
    for x in out:
        if struct.unpack("f", struct.pack("f", x))[0] != x:
            raise OutOfRange(f"{x} isn't exactly a float")
    return out
