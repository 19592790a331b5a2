"""What the next run over a collection's points must process, by the difference of table versions.

Deliveries of points are commits of a versioned table: immutable files under immutable manifests (`ledger`). A run over a
collection saw the version of that table at its snapshot. What the last completed runs left is one commit of the output
table (`replay`): the version of each point they covered, whether the run had come to it, and as properties of that
very commit the ledger version covered by collection. Runs that did not complete have committed nothing and leave no trace. The
next run (`run`) reads these properties, takes the difference of the manifests, hence only files added since, and commits what it
finds together with the version reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.runtime import scratch
from vantor.sources.versioned import VersionedTable, progress, run_incremental

DONE = "completed"


def change_time(df: DataFrame) -> Column:
    """The latest of the non-null time columns of a row."""
    return F.greatest(*(F.col(c) for c in ("created_at", "updated_at", "deleted_at")))


def last_runs(jobs: DataFrame) -> DataFrame:
    """Rows (collection_id, snapshot_at, checkpoint_at, last_source_point_id): each collection's completed run with the latest snapshot.

    Runs without collection or snapshot don't count. Of runs with one snapshot the one that got furthest holds.
    """
    done = jobs.where((F.col("status") == DONE) & F.col("collection_id").isNotNull() & F.col("snapshot_at").isNotNull())
    latest = done.groupBy("collection_id").agg(F.max(F.struct("snapshot_at", "checkpoint_at", "last_source_point_id")).alias("run"))
    return latest.select("collection_id", "run.*")


def ledger(points: DataFrame, runs: DataFrame, path: str) -> tuple[VersionedTable, dict[int, int]]:
    """The deliveries as commits of a versioned table (point_id, collection_id, changed_at, loaded_at), and the version that each collection's run saw.

    A version ends with the rows loaded up to and including a snapshot, so that a run's snapshot is a version; there are as
    many as different snapshots of last runs, at most one per collection. Rows without loaded_at come with the last version,
    as no run is known to have seen them. Rows without point_id are left out.
    """
    seen = [(r[0], r[1]) for r in runs.select("collection_id", F.col("snapshot_at").cast("string")).collect()]  # one row per collection
    kind = points.schema["loaded_at"].dataType.simpleString()
    cuts = sorted({s for _, s in seen})
    rows = points.where(F.col("point_id").isNotNull()).select("point_id", "collection_id", change_time(points).alias("changed_at"), "loaded_at")
    epoch = F.lit(0)
    if cuts:
        times = F.array(*(F.lit(c).cast(kind) for c in cuts))
        epoch = F.when(F.col("loaded_at").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(times, lambda c: c < F.col("loaded_at"))))
    table = VersionedTable(points.sparkSession, path)
    versions = table.load(rows.withColumn("epoch", epoch), "epoch", len(cuts) + 1)
    return table, {c: versions[cuts.index(s)] for c, s in seen}


def replay(table: VersionedTable, seen: dict[int, int], runs: DataFrame, path: str) -> VersionedTable:
    """The output table with one commit, the state that the last completed runs left: rows (point_id, collection_id, changed_at, pending).

    One row per point of the version its run saw, with its latest change then; pending if the run had not come to it. The
    versions covered are properties of the commit.
    """
    target = VersionedTable(table.spark, path)
    covered = table.seen_by("collection_id", seen).groupBy("point_id", "collection_id").agg(F.max("changed_at").alias("changed_at"))
    state = covered.join(F.broadcast(runs), "collection_id")  # one row per collection
    state = state.select("point_id", "collection_id", "changed_at", F.coalesce(_behind("changed_at", "point_id"), F.lit(False)).alias("pending"))
    target.commit(state, properties=progress("points", 0, seen))
    return target


def run(table: VersionedTable, target: VersionedTable) -> int:
    """The next run: commits to the target, as pending, the points whose present version came with deliveries that no completed run saw.

    Of the ledger only files added since the saved versions are read. A delivery of a version that was covered
    before, or of an older one, makes no point pending.
    """
    covered = target.read().select("point_id", "collection_id", F.col("changed_at").alias("_covered"), F.lit(True).alias("_known"))

    def fresh(changes: DataFrame) -> DataFrame:
        new = changes.groupBy("point_id", "collection_id").agg(F.max("changed_at").alias("changed_at"))
        both = new.join(covered, ["point_id", "collection_id"], "left")
        later = F.col("changed_at").isNotNull() & (F.col("_covered").isNull() | (F.col("changed_at") > F.col("_covered")))
        return both.where(F.col("_known").isNull() | later).select("point_id", "collection_id", "changed_at", F.lit(True).alias("pending"))

    return run_incremental(table, target, fresh, "points", "collection_id")


def record_deltas(points: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows that each collection's last completed run has not covered: (point_id, collection_id, changed_at, loaded_at, reason).

    reason is "added" for rows out of the manifests' difference, "unread" for rows of the run's own version behind the
    position at which it stopped. Repeated rows stay repeated; rows without point_id are left out.
    """
    runs = last_runs(jobs)
    table, seen = ledger(points, runs, scratch(points.sparkSession, "ledger"))
    new = table.changes_by("collection_id", seen).drop("_change").withColumn("reason", F.lit("added"))
    tail = table.seen_by("collection_id", seen).join(F.broadcast(runs), "collection_id").where(_behind("changed_at", "point_id"))
    return new.unionByName(tail.select("point_id", "collection_id", "changed_at", "loaded_at", F.lit("unread").alias("reason")))


def _behind(changed: str, point: str) -> Column:
    """Whether (changed, point) comes after the run's position."""
    later = F.col(changed) > F.col("checkpoint_at")
    return later | ((F.col(changed) == F.col("checkpoint_at")) & (F.col(point) > F.col("last_source_point_id")))


def pending_points(points: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows (point_id): points whose present version the last completed run of their collection has not covered.

    The deliveries become a ledger, the last completed runs the state they left, and one more run adds what the ledger's
    manifests have beyond the versions saved with that state.

    The present version has the latest time of change; delivered more than once, it counts as loaded at its earliest
    loaded_at. Null point_id: left out. Null collection_id: no run, hence always pending. All times null: the earliest change.
    Null loaded_at: never seen, unless the same version was also delivered with one. Empty tables and repeated rows are
    fine; without any completed run every point is pending. Other columns are ignored.
    """
    spark, runs = points.sparkSession, last_runs(jobs)
    table, seen = ledger(points, runs, scratch(spark, "ledger"))
    target = replay(table, seen, runs, scratch(spark, "pending"))
    run(table, target)
    return target.read().where("pending").select("point_id").distinct()
