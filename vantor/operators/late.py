"""Late interaction: MaxSim, the sum over query vectors of the best inner product with any token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.errors import BudgetExceeded, InvalidParameter
from vantor.functions import scoring, vectors

MAX_COMPARISONS = 1_000_000


def check_queries(queries: Sequence[Sequence[float]]) -> list[list[float]]:
    if not queries:
        raise InvalidParameter("late interaction needs query vectors")
    out = [vectors.check_vector(q) for q in queries]
    if len({len(q) for q in out}) > 1:
        raise InvalidParameter("query vectors must share one dimension")
    return out


def max_sim(tokens: Column, queries: Sequence[Sequence[float]]) -> Column:
    """The score of an array of token vectors; a null or empty array is an error (22023), as is another dimension."""
    return scoring.best_products(tokens, check_queries(queries))


def sum_of_best(rows: DataFrame, keys: Sequence[str], products: str, count: int) -> DataFrame:
    """Rows (keys, score): the best of each query's products over a point's rows, by hash aggregation, then their sum."""
    best = rows.groupBy(*keys).agg(*(F.max(F.get(products, F.lit(i))).alias(f"_{i}") for i in range(count)))
    return best.select(*keys, F.aggregate(F.array(*(F.col(f"_{i}") for i in range(count))), F.lit(0.0), lambda s, x: s + x).alias("score"))


def max_sim_rows(tokens: DataFrame, point: str, vector: str, queries: Sequence[Sequence[float]]) -> DataFrame:
    """Rows (point_id, score) from one row per token: the best product per query vector by hash aggregation, then their sum.

    The form for large token tables: partial maxima are combined before the shuffle, and no point's tokens are collected.
    Null vectors are skipped.
    """
    wanted = check_queries(queries)
    rows = tokens.where(F.col(vector).isNotNull()).select(F.col(point).alias("point_id"), scoring.products(F.col(vector), wanted).alias("_p"))
    return sum_of_best(rows, ["point_id"], "_p", len(wanted))


def check_offsets(offsets: Sequence[int], count: int, points: int) -> None:
    """Offsets of an inline candidate list: from 0 to the number of vectors, strictly increasing, one more than the points."""
    if len(offsets) != points + 1 or offsets[0] != 0 or offsets[-1] != count or any(a >= b for a, b in zip(offsets, offsets[1:], strict=False)):
        raise InvalidParameter("malformed offsets")


def rerank(spark, queries: Sequence[Sequence[float]], point_ids: Sequence[int], candidates: Sequence[Sequence[float]], offsets: Sequence[int], limit: int) -> DataFrame:
    """Rows (point_id, score) of the best of inline candidates, best first; candidate i has the vectors from offsets[i] to offsets[i + 1]."""
    queries = check_queries(queries)
    check_offsets(offsets, len(candidates), len(point_ids))
    if len(queries) * len(candidates) > MAX_COMPARISONS:
        raise BudgetExceeded("too many comparisons")
    rows = [(int(p), [vectors.check_vector(v, len(queries[0])) for v in candidates[a:b]]) for p, a, b in zip(point_ids, offsets, offsets[1:], strict=False)]
    df = spark.createDataFrame(rows, "point_id bigint, tokens array<array<double>>")
    return df.select("point_id", max_sim(F.col("tokens"), queries).alias("score")).orderBy(F.desc("score"), "point_id").limit(limit)
