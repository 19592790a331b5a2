"""Session helpers: reading tables, and cutting lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.errors import NotReady


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session (one machine, as in tests) gets a temporary one; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise NotReady("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="vantor-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/vantor-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python, once per application, by an archive in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = scratch(spark, "package") + ".zip"
    atexit.register(_delete, spark, path)
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(archive.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as a table into the shared folder and reads it back.

    Used where a result is read more than once or feeds a later step that must see the very same rows (a range
    partitioning, an iteration). The files outlive any executor, and reads keep column pruning and pushdown. They are
    deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a materialized table that no later read needs."""
    if isinstance(df_or_path, str):
        _delete(spark, df_or_path)
        return
    for file in df_or_path.inputFiles()[:1]:
        _delete(df_or_path.sparkSession, file.rsplit("/", 1)[0])


def finite(score: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf")))


def folded(text: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.regexp_replace(text, r"^[\s 　]+|[\s 　]+$", ""))


def drawn(df: DataFrame, by: Column, wanted: int, total: int) -> DataFrame:
    """About the `wanted` rows of the smallest hashes `by` (xxhash64) out of `total`, at most so many.

    Rows of larger hashes are filtered out where they are read, so that the task which orders the rest gets about twice
    the wanted rows, however many there are.
    """
    bound = min((1 << 63) - 1, int(-(1 << 63) + min(1.0, 2.0 * wanted / max(1, total)) * (1 << 64)))
    return df.where(by <= F.lit(bound)).orderBy(by).limit(wanted)


def hot_limit(total: int, least: int, groups: int = 50_000) -> int:
    """Rows from which on a group counts as hot: at most `groups` groups can reach it, so a table of them is bounded."""
    return max(least, total // groups)


def numbered(df: DataFrame, order: list[str], start: int = 0, out: str = "number") -> DataFrame:
    """df with consecutive numbers from start + 1 in the order of the columns, without a task that holds all rows.

    Rows are range-partitioned and sorted; a row's number is its position in its partition plus the sizes of the
    partitions before. The order must be total for the numbers to be reproducible.
    """
    keys = [F.asc(c) for c in order]
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = materialize(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("_part").count().collect())  # one row per partition
    shifts, total = [], start
    for part, size in sizes:
        shifts.append((part, total + 1))
        total += size
    if not shifts:
        return df.withColumn(out, F.lit(None).cast("bigint")).limit(0)
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    return rows.join(F.broadcast(shift), "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
