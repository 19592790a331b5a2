"""Top N items of every group, by a hot-cold split.

Exact counts of each group's items tell hot groups from the rest. Cold groups go through an ordinary window. Items of
hot groups are dealt out over score ranges and salts, each part keeps its first N, and one more window over those few
survivors decides. Both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantor.runtime import finite, folded, hot_limit, materialize

RANGES, SALTS = 16, 8


def best_per_item(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row per (group, item) with its highest finite score, as columns grp, item, score.

    Rows whose group or item is null or whose score is null, NaN or infinite are left out.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & finite(F.col("score")))
    return rows.groupBy("grp", "item").agg(F.max("score").alias("score"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, hot_rows: int = 100_000) -> DataFrame:
    """Rows (group, item, score, place) of the first n items of each group.

    Order: score descending, then item ascending; places count from 1. An item that comes several times in a group has
    its highest score there. Null groups, null items and scores that are null, NaN or infinite are left out; an empty
    table gives an empty result; other columns are ignored, whatever their names.

    hot_rows: groups with at least so many items, and more than a fifty-thousandth of all items, are hot. At most 50,000 groups
    can be hot, so the table of hot groups that is broadcast is bounded.
    """
    if n < 1:
        raise ValueError("n must be positive")
    best = materialize(best_per_item(df, group, item, score), "topn")
    counts = best.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = best.count()
    hot_names = counts.where(F.col("n") >= hot_limit(total, hot_rows)).select("grp")
    hot_names = best.sparkSession.createDataFrame(hot_names.collect(), hot_names.schema)  # at most 50,000 rows
    order = [F.desc("score"), F.asc("item")]
    cold = best.join(F.broadcast(hot_names), "grp", "left_anti")
    cold = cold.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("place") <= n)
    hot = best.join(F.broadcast(hot_names), "grp", "left_semi")
    edges = hot.groupBy("grp").agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 1000).alias("edges"))
    salted = hot.join(F.broadcast(edges), "grp").select(
        "grp", "item", "score",
        F.size(F.filter("edges", lambda e: e < F.col("score"))).alias("range"),
        F.pmod(F.hash("item"), F.lit(SALTS)).alias("salt"),
    )
    part = Window.partitionBy("grp", "range", "salt").orderBy(*order)
    survivors = salted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= n)
    hot = survivors.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("place") <= n)
    out = cold.select("grp", "item", "score", "place").unionByName(hot.select("grp", "item", "score", "place"))
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), "score", "place")


def top_per_category(candidates: DataFrame, n: int = 10, hot_rows: int = 100_000) -> DataFrame:
    """Top n points of each category; categories that differ in letter case or surrounding space are one, blank ones are left out."""
    rows = candidates.select(folded(F.col("category")).alias("category"), "point_id", "score").where(F.col("category") != "")
    return top_n(rows, "category", "point_id", "score", n, hot_rows)
