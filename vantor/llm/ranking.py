"""Places within groups, exact also where one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantor.runtime import hot_limit, materialize

_LOW33 = (1 << 33) - 1


def places(df: DataFrame, group: list[str], score: str, item: str, out: str = "place", hot_rows: int = 200_000) -> DataFrame:
    """df with the place (from 1) of each row within its group, by score descending, then item ascending.

    (group, item) must be unique and score not null. Groups under the limit are ranked by a window. Rows of hot groups
    (at most 50,000 groups, see hot_limit) are range-partitioned by the full order, so that no task holds a whole group;
    a row's place is its position in its partition plus the sizes of the group's parts in the partitions before.

    df is read several times: pass a table or a materialized result.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    names = counts.where(F.col("_n") >= hot_limit(total, hot_rows)).select(*group)
    found = names.collect()  # at most 50,000 rows
    order = [F.desc(score), F.asc(item)]
    window = Window.partitionBy(*group).orderBy(*order)
    if not found:
        return df.withColumn(out, F.row_number().over(window))
    names = df.sparkSession.createDataFrame(found, names.schema)
    cold = df.join(F.broadcast(names), group, "left_anti").withColumn(out, F.row_number().over(window))
    hot = df.join(F.broadcast(names), group, "left_semi")
    keys = [F.asc(g) for g in group] + order
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = hot.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    hot = hot.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)).alias("_at"))
    hot = materialize(hot, "places")
    sizes = hot.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "_part", (before - F.col("_first") + 1).alias("_shift"))
    hot = hot.join(sizes, [*group, "_part"]).withColumn(out, (F.col("_at") + F.col("_shift")).cast("int"))
    return cold.unionByName(hot.select(*cold.columns))
