"""Element-wise aggregates of vectors by group.

Dense vectors are added up per Arrow batch and group first, so that what is shuffled is a sum per batch and group; those
are added by position in a hash aggregation and put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from vantor.errors import InvalidParameter
from vantor.functions.half import round_half
from vantor.functions.vectors import error

#: Largest dimension for which the bits' aggregates are written out.
WIDEST = 64


def _finish(total: Column, count: Column, how: str) -> Column:
    value = total / count if how == "avg" else total
    return F.when(F.abs(value) < float("inf"), value).when(value.isNotNull(), error("22003: overflow"))


def _plain(c: str) -> Column:
    return F.col(f"`{c}`")


def _partial_sums(rows: DataFrame, keys: list[str], dims: int | None) -> DataFrame:
    """Rows (keys, _d, _s), one per batch and group: the dimension, and an array of the number of vectors and their sums. Null values count as 0."""
    places = [f"_{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            valid = batch.column(len(keys)).is_valid()
            # rows without a vector only keep their group alive
            of = pa.table([*batch.columns[: len(keys)], pa.array(np.arange(batch.num_rows))], [*places, "_row"])
            codes = np.zeros(batch.num_rows, np.int64)
            for i in range(len(keys)):
                one = of.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
                one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
                codes = np.unique(codes * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            _, first = np.unique(codes, return_index=True)
            vectors = batch.column(len(keys)).filter(valid)
            code = codes[valid.to_numpy(zero_copy_only=False)]
            offsets = vectors.offsets.to_numpy()
            wide = np.unique(np.diff(offsets))
            if len(wide) > 1 or (dims is not None and len(wide) and wide[0] != dims):
                raise ValueError("22023: dimension mismatch")
            width = int(wide[0]) if len(wide) else 0
            values = vectors.values.fill_null(0.0).to_numpy(zero_copy_only=False)
            sums = np.zeros((len(first), width + 1))
            for at in range(0, len(code), 4096):
                c = code[at : at + 4096]
                part = values[offsets[at] : offsets[at + len(c)]].reshape(len(c), width)
                order = np.argsort(c, kind="stable")
                begin = np.nonzero(np.concatenate([[True], c[order][1:] != c[order][:-1]]))[0]
                with np.errstate(all="ignore"):
                    sums[c[order][begin], 1:] += np.add.reduceat(part[order], begin, axis=0)
            sums[:, 0] = np.bincount(code, minlength=len(first))
            ends = np.arange(len(first) + 1, dtype=np.int32) * (width + 1)
            named = batch.take(pa.array(first)).columns[: len(keys)]
            d = pa.array(np.full(len(first), width, np.int32), mask=sums[:, 0] == 0)
            yield pa.RecordBatch.from_arrays([*named, d, pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))], [*keys, "_d", "_s"])

    schema = StructType([*(rows.schema[k] for k in keys), StructField("_d", IntegerType()), StructField("_s", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema)


def aggregate_vectors(df: DataFrame, keys: list[str], vector: str, how: str = "avg", dims: int | None = None, half: bool = False, out: str = "value", counted: str | None = None) -> DataFrame:
    """Rows (keys, out): the sum or average of each group's vectors in double precision, or rounded to half precision.

    counted names a further column with the number of vectors that aren't null.

    Null vectors are skipped; a group without any has null. Vectors of another dimension than dims, or than each other,
    are an error. Without keys the result is one row, also for an empty table.
    """
    if how not in ("sum", "avg"):
        raise InvalidParameter("how must be sum or avg")
    rows = df.select(*(_plain(k) for k in keys), _plain(vector).cast("array<double>").alias("_v"))
    parts = _partial_sums(rows, keys, dims).select(*keys, "_d", F.posexplode("_s").alias("_p", "_x"))
    parts = parts.groupBy(*keys, "_p").agg(F.sum("_x").alias("_x"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_s"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    count = F.coalesce(F.get("_s", F.lit(0))["_x"].cast("bigint"), F.lit(0).cast("bigint"))
    count = F.when(F.coalesce(F.col("_low") == F.col("_high"), F.lit(True)), count).otherwise(error("22023: dimension mismatch", "bigint"))
    whole = whole.select(*keys, count.alias("_n"), F.transform(F.slice("_s", 2, 1_000_000), lambda s: s["_x"]).alias("_v"))
    value = F.when(F.col("_n") > 0, F.transform("_v", lambda x: _finish(x, F.col("_n"), how)))
    done = whole.select(*keys, value.alias(out), *([F.col("_n").alias(counted)] if counted else []))
    return done.withColumn(out, F.transform(out, round_half)) if half else done


def aggregate_sparse(df: DataFrame, keys: list[str], vector: str, how: str = "avg", out: str = "value") -> DataFrame:
    """The sum or average of sparse vectors; entries that come to zero are dropped. Nulls, dimensions and groups as for dense ones."""
    if how not in ("sum", "avg"):
        raise InvalidParameter("how must be sum or avg")
    rows = df.select(*(_plain(k) for k in keys), _plain(vector).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v.dims").alias("_low"), F.max("_v.dims").alias("_high"))
    entries = rows.select(*keys, F.explode(F.arrays_zip(F.col("_v.indices").alias("i"), F.col("_v.values").alias("x"))).alias("_e"))
    sums = entries.groupBy(*keys, F.col("_e.i").alias("_i")).agg(F.sum(F.col("_e.x").cast("double")).alias("_x")).where(F.col("_x") != 0)
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_e"))
    whole = whole.select(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)), "_e")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    joined = sizes.join(whole, on, "left") if on else sizes.join(whole, F.lit(True), "left")
    dims = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low").isNotNull(), error("22023: dimension mismatch", "int"))
    pairs = F.coalesce("_e", F.array().cast("array<struct<_i:int,_x:double>>"))
    value = F.struct(
        dims.alias("dims"), F.transform(pairs, lambda p: p["_i"]).alias("indices"),
        F.transform(pairs, lambda p: _finish(p["_x"], F.col("_n"), how).cast("float")).alias("values"),
    )
    return joined.select(*keys, F.when(F.col("_n") > 0, value).alias(out))


def aggregate_bits(df: DataFrame, keys: list[str], vector: str, how: str = "or", dims: int | None = None, out: str = "value") -> DataFrame:
    """Element-wise or/and of bit vectors. Nulls are skipped; dimensions must agree."""
    if how not in ("or", "and"):
        raise InvalidParameter("how must be or/and")
    rows = df.select(*(_plain(k) for k in keys), F.transform(_plain(vector), lambda b: b.cast("int")).alias("_v"))
    best = F.max if how == "or" else F.min
    if dims is not None and dims <= WIDEST:
        checked = F.when(F.size("_v") == dims, F.col("_v")).when(F.col("_v").isNotNull(), error("22023: dimension mismatch", "array<int>"))
        rows = rows.withColumn("_v", checked)
        done = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), *(best(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(dims)))
        return done.select(*keys, F.when(F.col("_n") > 0, F.array(*(F.col(f"_{i}") == 1 for i in range(dims)))).alias(out))
    parts = rows.select(*keys, F.posexplode("_v").alias("_p", "_x")).groupBy(*keys, "_p").agg(best("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"] == 1).alias(out))
