"""Fusing ranked branches into one ranking. Branches are DataFrames (point_id, source_key, score) of at most a limit's rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter

#: MOST is the greatest limit of a search, and hence of a branch.
RRF_K, MOST = 60, 10_000


@dataclass(frozen=True)
class Branch:
    rows: DataFrame
    lower_is_better: bool
    weight: float = 1.0


def best_first(b: Branch) -> list:
    return [F.asc("score") if b.lower_is_better else F.desc("score"), F.asc("point_id")]


def _cut(b: Branch) -> DataFrame:
    """The branch's first MOST rows, so that ranking them in one task is bounded whatever is passed."""
    return b.rows.orderBy(*best_first(b)).limit(MOST)


def rrf(branches: Sequence[Branch], k: float = RRF_K) -> DataFrame:
    """Rows (point_id, source_key, score): the sum over branches of 1 / (k + rank), the higher the better.

    The rank is the position in the branch from 1 on; a point that a branch holds twice counts at its first position,
    but later rows keep theirs. A branch holds at most MOST rows, the greatest limit of a search; the first so many count.
    """
    if not branches:
        raise InvalidParameter("nothing to fuse")
    parts = []
    for i, b in enumerate(branches):
        ranked = _cut(b).withColumn("rank", F.row_number().over(Window.orderBy(*best_first(b))))
        parts.append(ranked.groupBy("point_id").agg(F.min("rank").alias("rank"), F.min("source_key").alias("source_key")).withColumn("b", F.lit(i)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("point_id").agg(F.min("source_key").alias("source_key"), F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted(branches: Sequence[Branch], by: Sequence[str] = ()) -> DataFrame:
    """Rows (point_id, source_key, score): the weighted mean of the branches' scores scaled to 0..1, the higher the better.

    Each branch is scaled by its least and greatest score, upside down for distances; a constant branch counts 1. A
    point's best score in a branch holds. Branches of weight 0 are skipped; negative or non-finite weights, or none above 0,
    are errors.

    Without `by` a branch's first MOST rows count. by: columns of the branches, such as a query's id; each of their values gets a ranking of its own, in which only its
    rows count, and the columns come first. A branch without rows for a value counts 0 for it, as an empty branch does.
    """
    if any(not math.isfinite(b.weight) or b.weight < 0 for b in branches):
        raise InvalidParameter("weights must be finite and not negative")
    total = sum(b.weight for b in branches)
    if not total > 0:
        raise InvalidParameter("no branch has a weight above 0")
    point, rows = [*by, "point_id"], None
    for b in branches:
        if not b.weight:
            continue
        sign = -1.0 if b.lower_is_better else 1.0
        best = (b.rows if by else _cut(b)).groupBy(*point).agg(F.max(F.col("score") * sign).alias("s"), F.min("source_key").alias("source_key"))
        whole = Window.partitionBy(*by)  # a limit's rows
        low, high = F.min("s").over(whole), F.max("s").over(whole)
        # scaled first, so that the difference of extreme scores doesn't overflow
        scale = F.greatest(F.abs(low), F.abs(high))
        unit = F.when(low == high, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("s") / scale - low / scale) / (high / scale - low / scale))))
        part = best.select(*point, "source_key", (unit * (b.weight / total)).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*point).agg(F.min("source_key").alias("source_key"), F.sum("score").alias("score"))
