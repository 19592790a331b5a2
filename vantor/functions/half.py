"""Half-precision vectors: arrays of float whose values are all binary16 values, rounded to nearest, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.functions import vectors
from vantor.functions.vectors import compare, cosine_distance, dims, inner_product, l1_distance, l2_distance, negative_inner_product, to_text

__all__ = ["compare", "cosine_distance", "dims", "from_array", "inner_product", "l1_distance", "l2_distance", "negative_inner_product", "parse", "round_half", "to_text", "to_vector"]

LARGEST = 65_504.0


def round_half(x: Column) -> Column:
    """The nearest binary16 value; beyond the largest one an error (22003)."""
    x = x.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-24))))
    # the logarithm may be off by a rounding at powers of two
    power = F.when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).when(size < F.pow(F.lit(2.0), guess), guess - 1).otherwise(guess)
    unit = F.pow(F.lit(2.0), F.greatest(power, F.lit(-14)) - 10)
    value = F.rint(x / unit) * unit
    return F.when(F.abs(value) <= LARGEST, value.cast("float")).when(x.isNotNull(), vectors.error("22003: value out of range of half precision", "float"))


def from_array(v: Column) -> Column:
    """A half vector from an array of int, float or double, rounding each value."""
    good = (F.size(v) > 0) & (F.size(v) <= vectors.MAX_DIMENSIONS) & F.forall(v, lambda x: x.isNotNull())
    return F.when(good, F.transform(v, round_half)).when(v.isNotNull(), vectors.error("22P02: a vector needs finite values", "array<float>"))


def parse(text: Column) -> Column:
    return from_array(vectors.parse(text))


def to_vector(v: Column) -> Column:
    return v
