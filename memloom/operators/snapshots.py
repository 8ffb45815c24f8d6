"""Publishing of rebuilt communities (D6): runs, staged snapshots and the one that readers see, as one commit.

A run gets a fencing number: the first free one, taken by creating a file that must not exist yet. It may publish only while no later
run has begun, and its number can be published once. What fails after a publication publishes the snapshot before it again.
Runs' events are rows that `community.run_states` reads. The store's file system must create files atomically, as HDFS does.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.community import RUN_STATES, run_states, stage_snapshot

EVENT = "run_id string, workspace string, state string, snapshot_id string, seq long"
POINTER = "snapshot_id string, seq long"


class RefusedError(RuntimeError):
    """Another run came later, or has published under this number."""


class SnapshotStore:
    """The snapshots of one workspace in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, workspace: str = "default"):
        self.spark, self.path, self.workspace = spark, path, workspace

    def _claim(self, name: str) -> bool:
        """Creates an empty file; False if it is there already. On a disk of this machine by the system's own exclusive creation, which
        Spark's local file system lacks."""
        fs, at = self._file_system(name)
        if at.toUri().getScheme() in (None, "file"):
            local = at.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            return fs.createNewFile(at)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise

    def _file_system(self, name: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, name: str, shape: str) -> DataFrame:
        try:
            return self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], shape)

    def _latest(self) -> int:
        fs, at = self._file_system("fences")
        return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=0) if fs.exists(at) else 0

    def _tell(self, run_id: str, state: str, snapshot_id: str | None, fence: int) -> None:
        """An event in a folder of its own, so that runs do not write to one."""
        no = RUN_STATES.index(state)
        self.spark.createDataFrame([(run_id, self.workspace, state, snapshot_id, 10 * fence + no)], EVENT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/{fence:012d}-{no}")

    def begin(self, run_id: str) -> int:
        """A run's fencing number; those of earlier runs no longer publish."""
        fence = self._latest() + 1
        while not self._claim(f"fences/{fence:012d}"):
            fence += 1
        self._tell(run_id, "running", None, fence)
        return fence

    def stage(self, run_id: str, fence: int, members: DataFrame, snapshot_id: str) -> None:
        """Writes a snapshot's members (node, community_id), unseen by readers."""
        stage_snapshot(members, self.path, snapshot_id)
        self._tell(run_id, "staged", snapshot_id, fence)

    def _point(self, snapshot_id: str, fence: int) -> None:
        if self._latest() != fence or not self._claim(f"claims/{fence:012d}"):
            raise RefusedError(f"run number {fence} may not publish")
        self.spark.createDataFrame([(snapshot_id, fence)], POINTER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/published/{fence:012d}")

    def publish(self, run_id: str, fence: int, snapshot_id: str) -> None:
        """Readers see this snapshot from here on, unless a later run has begun or this number was used: then RefusedError."""
        self._point(snapshot_id, fence)
        self._tell(run_id, "published", snapshot_id, fence)

    def pointer(self) -> str | None:
        """The id of the snapshot that readers see."""
        row = self._read("published/*", POINTER).orderBy(F.desc("seq")).first()
        return row.snapshot_id if row and row.snapshot_id else None

    def members(self) -> DataFrame:
        """The members of the snapshot that readers see; none before the first publication."""
        now = self.pointer()
        shape = "node string, community_id string, snapshot_id string"
        return self._read("staged", shape).filter(F.col("snapshot_id") == now) if now else self.spark.createDataFrame([], shape)

    def states(self) -> DataFrame:
        return run_states(self._read("runs/*", EVENT))

    def rebuild(self, run_id: str, build: Callable[[], DataFrame], project: Callable[[DataFrame], None] | None = None) -> str:
        """A whole run: build's members are staged and published, then handed to project. If a step fails, readers see what they saw
        before, project gets that again, the run is failed, and the error goes on. The new snapshot's id."""
        was, seen = self.pointer(), self.members()
        fence = self.begin(run_id)
        snapshot_id = f"{run_id}-{fence}"
        try:
            self.stage(run_id, fence, build(), snapshot_id)
            if project:  # readers of the projection and of the store change together, or not at all
                project(self._read("staged", "node string, community_id string, snapshot_id string").filter(F.col("snapshot_id") == snapshot_id))
            self.publish(run_id, fence, snapshot_id)
        except Exception:
            if project and self._latest() == fence:
                project(seen)
            if self.pointer() != was and self._latest() == fence:
                self._point(was or "", self.begin(f"{run_id}-restore"))
            self._tell(run_id, "failed", None, fence)
            raise
        return snapshot_id
