"""Build jobs and artifacts: a state machine for resumable builds, and checksummed artifact segments with a life cycle."""

from __future__ import annotations

import dataclasses
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vantor.errors import Corrupt, Duplicate, InvalidParameter, NotReady, UnknownCollection
from vantor.sources.versioned import VersionedTable

ACTIVE = ("planned", "running", "cancel_requested")
FINAL = ("completed", "failed", "cancelled", "abandoned")


@dataclass
class BuildJob:
    build_job_id: int
    collection_name: str
    artifact_kind: str
    artifact_name: str
    target_name: str
    total_units: int
    status: str = "planned"
    attempt: int = 1
    processed_units: int = 0
    error_message: str | None = None

    def start(self) -> None:
        self._from("planned")
        self.status = "running"

    def advance(self, units: int) -> None:
        """Adds progress, at most up to the total, which completes the job; a job whose cancellation was asked for is cancelled instead."""
        if units < 1:
            raise InvalidParameter("a step has at least one unit")
        self._from("running", "cancel_requested")
        if self.status == "cancel_requested":
            self.status = "cancelled"
            return
        self.processed_units = min(self.total_units, self.processed_units + units)
        if self.processed_units == self.total_units:
            self.status = "completed"

    def request_cancel(self) -> None:
        self._from("running", "planned")
        self.status = "cancel_requested" if self.status == "running" else "cancelled"

    def fail(self, message: str) -> None:
        self._from("running", "cancel_requested")
        self.status, self.error_message = "failed", message

    def abandon(self) -> None:
        self._from("running", "cancel_requested")
        self.status = "abandoned"

    def retry(self) -> None:
        """Starts again with the progress made."""
        self._from("failed", "cancelled", "abandoned")
        self.status, self.attempt, self.error_message = "running", self.attempt + 1, None

    def _from(self, *states: str) -> None:
        if self.status not in states:
            raise InvalidParameter(f"a job that is {self.status} can't do that")


class BuildJobs:
    """Build jobs, at most one active per target. With a path they are kept in a versioned table there, each change as a commit, and outlive the driver."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.jobs = spark, {}
        self._kept = None if path is None else VersionedTable(spark, path)
        if self._kept is not None and self._kept.version():
            for r in sorted(self._kept.read().collect(), key=lambda r: r.build_job_id):  # one row per job
                self.jobs[r.build_job_id] = BuildJob(**r.asDict())

    def save(self) -> None:
        """Commits the jobs as they are; of two drivers that do so at once one gets a Conflict."""
        if self._kept is not None:
            self._kept.replace(self.listing().coalesce(1))

    def start(self, collection: str, kind: str, name: str, target: str, total: int) -> BuildJob:
        if total < 1:
            raise InvalidParameter("a job has at least one unit")
        if any(j.status in ACTIVE and (j.collection_name, j.target_name) == (collection, target) for j in self.jobs.values()):
            raise Duplicate(f"{target} is being built")
        job = BuildJob(len(self.jobs) + 1, collection, kind, name, target, total)
        job.start()
        self.jobs[job.build_job_id] = job
        self.save()
        return job

    def job(self, build_job_id: int) -> BuildJob:
        if build_job_id not in self.jobs:
            raise UnknownCollection(f"build job {build_job_id} doesn't exist")
        return self.jobs[build_job_id]

    def update(self, build_job_id: int, processed: int, status: str, message: str | None = None) -> BuildJob:
        """Sets progress, which never falls, and status; a final status stays."""
        job = self.job(build_job_id)
        if job.status in FINAL:
            raise InvalidParameter("the job has ended")
        if not job.processed_units <= processed <= job.total_units:
            raise InvalidParameter("progress must not fall or pass the total")
        if status not in ACTIVE + FINAL:
            raise InvalidParameter(f"unknown status {status}")
        if status == "completed" and processed != job.total_units:
            raise InvalidParameter("a completed job has all its units")
        job.processed_units, job.status, job.error_message = processed, status, message
        self.save()
        return job

    def run(self, build_job_id: int, work: Callable[[int, int], None], step: int = 1) -> BuildJob:
        """Works through the remaining units by steps, work(first, last) each; an error fails the job and keeps its progress."""
        job = self.job(build_job_id)
        while job.status in ("running", "cancel_requested"):
            if job.status == "running":
                try:
                    work(job.processed_units, min(job.total_units, job.processed_units + step))
                except Exception as e:  # noqa: BLE001 - whatever the work raises is the job's error
                    job.fail(str(e))
                    self.save()
                    break
            job.advance(step)
            self.save()
        return job

    def listing(self, collection: str | None = None) -> DataFrame:
        kinds = {"build_job_id": "bigint", "total_units": "bigint", "attempt": "int", "processed_units": "bigint"}
        names = [f.name for f in dataclasses.fields(BuildJob)]
        rows = [dataclasses.astuple(j) for j in self.jobs.values() if collection in (None, j.collection_name)]
        return self.spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


# A segment: magic, version, kind, payload length and checksum, then the payload.
_HEAD = struct.Struct("<4sHHQI")
_MAGIC, _FORMAT = b"VSEG", 1
KINDS = ("vectors", "graph", "codes", "tokens")


def encode_segment(kind: str, payload: bytes) -> bytes:
    if kind not in KINDS:
        raise InvalidParameter(f"unknown segment kind {kind}")
    return _HEAD.pack(_MAGIC, _FORMAT, KINDS.index(kind), len(payload), zlib.crc32(payload)) + payload


def decode_segment(segment: bytes) -> tuple[str, bytes]:
    """(kind, payload); a damaged segment is an error (XX001)."""
    if len(segment) < _HEAD.size:
        raise Corrupt("segment is too short")
    magic, version, kind, size, checksum = _HEAD.unpack_from(segment)
    payload = segment[_HEAD.size :]
    if magic != _MAGIC or version != _FORMAT or kind >= len(KINDS):
        raise Corrupt("not a segment of this format")
    if len(payload) != size or zlib.crc32(payload) != checksum:
        raise Corrupt("the segment's payload is damaged")
    return KINDS[kind], payload


class Artifacts:
    """Published segments as files of the cluster's storage: put in place by rename, listed, checked, retired and removed."""

    def __init__(self, spark: SparkSession, path: str, jobs: BuildJobs) -> None:
        self.spark, self.path, self.jobs, self.rows = spark, path.rstrip("/"), jobs, []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

        # the rows are kept beside the segments, each change as a commit
        self._kept = VersionedTable(spark, f"{self.path}/catalog")
        if self._kept.version():
            self.rows = [r.asDict() for r in sorted(self._kept.read().collect(), key=lambda r: r.artifact_id)]  # one row per artifact

    def _save(self) -> None:
        self._kept.replace(self.listing().coalesce(1))

    def publish(self, build_job_id: int, segment: bytes) -> dict:
        job = self.jobs.job(build_job_id)
        if job.status != "completed":
            raise NotReady("the build job hasn't completed")
        kind, payload = decode_segment(segment)
        row = {"artifact_id": len(self.rows) + 1, "collection_name": job.collection_name, "build_job_id": build_job_id, "artifact_kind": job.artifact_kind, "artifact_name": job.artifact_name, "target_name": job.target_name, "segment_kind": kind, "payload_bytes": len(payload), "lifecycle_state": "published"}
        row["relative_path"] = f"{row['artifact_id']}-{zlib.crc32(segment):08x}.seg"
        draft, final = self._path(f"{self.path}/.{row['relative_path']}"), self._path(f"{self.path}/{row['relative_path']}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(segment))
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise Duplicate(f"{row['relative_path']} exists")
        for r in self.rows:
            if (r["collection_name"], r["artifact_name"]) == (job.collection_name, job.artifact_name) and r["lifecycle_state"] == "published":
                r["lifecycle_state"] = "superseded"
        self.rows.append(row)
        self._save()
        return row

    def _row(self, artifact_id: int) -> dict:
        if not 1 <= artifact_id <= len(self.rows):
            raise UnknownCollection(f"artifact {artifact_id} doesn't exist")
        return self.rows[artifact_id - 1]

    def read(self, artifact_id: int) -> tuple[str, bytes]:
        stream = self._fs.open(self._path(f"{self.path}/{self._row(artifact_id)['relative_path']}"))
        try:
            return decode_segment(bytes(self._io.toByteArray(stream)))
        finally:
            stream.close()

    def retire(self, artifact_id: int) -> dict:
        row = self._row(artifact_id)
        row["lifecycle_state"] = "retired"
        self._save()
        return row

    def cleanup(self, dry_run: bool = True) -> list[dict]:
        """Removes the files of retired and superseded segments; a dry run only names them."""
        due = [r for r in self.rows if r["lifecycle_state"] in ("retired", "superseded")]
        for r in due if not dry_run else []:
            self._fs.delete(self._path(f"{self.path}/{r['relative_path']}"), False)
            r["lifecycle_state"] = "removed"
        if due and not dry_run:
            self._save()
        return due

    def listing(self) -> DataFrame:
        kinds = {"artifact_id": "bigint", "build_job_id": "bigint", "payload_bytes": "bigint"}
        names = ["artifact_id", "collection_name", "build_job_id", "artifact_kind", "artifact_name", "target_name", "segment_kind", "payload_bytes", "lifecycle_state", "relative_path"]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))

    def diagnostics(self) -> DataFrame:
        """Rows (artifact_id, status, detail, repair_advice, cleanup_eligible): each file that should be there is read and checked."""
        rows = []
        for r in self.rows:
            eligible = r["lifecycle_state"] in ("retired", "superseded")
            try:
                if r["lifecycle_state"] == "removed":
                    rows.append((r["artifact_id"], "removed", None, "none", False))
                    continue
                self.read(r["artifact_id"])
                rows.append((r["artifact_id"], "ready", None, "none", eligible))
            except Corrupt as e:
                rows.append((r["artifact_id"], "corrupt", str(e), "build again", eligible))
            except Exception:  # noqa: BLE001 - the file system's own errors
                rows.append((r["artifact_id"], "missing", "file not found", "build again", eligible))
        return self.spark.createDataFrame(rows, "artifact_id bigint, status string, detail string, repair_advice string, cleanup_eligible boolean")
