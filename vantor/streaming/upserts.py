"""Points from a stream: each micro-batch is one commit of a versioned table, once, also when a batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from vantor.runtime import discard, materialize
from vantor.sources.versioned import VersionedTable


def upsert_stream(stream: DataFrame, path: str, key: str, version: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that keeps, in the table at path, each key's row with the latest `version`.

    The batch's number is saved in the commit that holds its rows, so a batch that is repeated after a failure is
    recognised. Within a batch the latest row of a key holds; rows older than the table's are ignored.
    """

    def batch(rows: DataFrame, number: int) -> None:
        table = VersionedTable(rows.sparkSession, path)
        base = table.version()
        if int(table.manifest(base).properties.get("batch", -1)) >= number:
            return
        newest = Window.partitionBy(key).orderBy(F.desc(version))
        fresh = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")
        if table.manifest(base).schema:
            there = table.read(base).select(key, F.col(version).alias("_there")).join(fresh.select(key), key, "left_semi")
            fresh = fresh.join(there, key, "left").where(F.col("_there").isNull() | (F.col(version) > F.col("_there"))).drop("_there")
        fresh = materialize(fresh.select(*rows.columns), "batch")  # read twice, and must be the same both times
        try:
            table.commit(fresh, base=base, properties={"batch": number}, delete_keys=fresh.select(key))
        finally:
            discard(fresh)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
