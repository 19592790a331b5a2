"""One ranking from several differently scaled scores, by reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.llm.ranking import places
from vantor.runtime import finite, materialize

RRF_K = 60


def branch_name(branch: Column) -> Column:
    """Branch names are compared without regard to letter case, "_" and "-"."""
    return F.lower(F.translate(branch, "_-", ""))


def branch_places(candidates: DataFrame, branches: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """Rows (query_id, branch, point_id, place): each branch's own ranking of its points.

    Null, NaN and infinite scores, null ids and branches of unknown direction are left out. A point has its best score
    within a query and branch; equal scores are ordered by point_id.
    """
    known = branches.select(
        branch_name(F.col("branch")).alias("branch"),
        F.when(F.lower("score_order") == "lowerisbetter", -1.0).when(F.lower("score_order") == "higherisbetter", 1.0).alias("sign"),
    ).where(F.col("sign").isNotNull() & F.col("branch").isNotNull()).dropDuplicates(["branch"])
    rows = candidates.where(finite(F.col("score")) & F.col("query_id").isNotNull() & F.col("point_id").isNotNull())
    rows = rows.select("query_id", branch_name(F.col("branch")).alias("branch"), "point_id", "score").join(known, "branch")
    best = rows.groupBy("query_id", "branch", "point_id").agg(F.max(F.col("score") * F.col("sign")).alias("best"))
    return places(materialize(best, "branches"), ["query_id", "branch"], "best", "point_id", "place", hot_rows).drop("best")


def fuse(candidates: DataFrame, branches: DataFrame, k: int = RRF_K, hot_rows: int = 200_000) -> DataFrame:
    """Rows (query_id, point_id, score, n_branches, of_branches, worst_place, place): the combined ranking.

    score is the sum of 1 / (k + place) over the branches that hold the point; the sum decides, then the smaller point_id.
    n_branches tells how many of the query's branches (of_branches) hold the point, worst_place its last place among them.

    Nulls, ties and repeated rows: see branch_places. Empty tables give an empty ranking; other columns are ignored.
    """
    ranked = materialize(branch_places(candidates, branches, hot_rows), "placed")
    left = ranked.groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("_n"))
    left = left.groupBy("query_id").agg(F.count(F.lit(1)).alias("of_branches"))
    fused = ranked.groupBy("query_id", "point_id").agg(
        F.sum(1.0 / (k + F.col("place"))).alias("_sum"), F.count(F.lit(1)).alias("n_branches"), F.max("place").alias("worst_place")
    )
    fused = fused.join(left, "query_id").select("query_id", "point_id", F.round("_sum", 12).alias("score"), "n_branches", "of_branches", "worst_place")
    return places(materialize(fused, "fused"), ["query_id"], "score", "point_id", "place", hot_rows)


def clear_winners(ranking: DataFrame, within: int = 2) -> DataFrame:
    """Rows (query_id, point_id): of queries with two branches or more, the first point of the ranking, if an exact check confirms it.

    The check: the point stands within the first `within` places of every branch its query has left, and no other does.
    A point that would pass it but doesn't come first by the sum is not returned: since 1/(k+1) + 1/(k+3) > 2/(k+2) for
    every k, a point with places 1 and 3 comes before one with places 2 and 2.
    """
    everywhere = (F.col("n_branches") == F.col("of_branches")) & (F.col("worst_place") <= within)
    few = ranking.where(everywhere & (F.col("of_branches") >= 2)).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"), F.min("point_id").alias("point_id"))
    return few.where((F.col("_n") == 1) & (F.col("_first") == 1)).select("query_id", "point_id")
