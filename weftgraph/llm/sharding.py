"""Sharding by size-tiered compaction: immutable runs, target-sized files, a versioned manifest.

A store is a folder of the shared file system. Each arrival is appended as a run: a folder of small
files that never change. Runs fall into tiers by size; when a tier holds ``FAN_IN`` runs, these are
merged into one run of target-sized files, without a shuffle. A run whose files have reached the
target is finished. Each change commits a new version of the manifest, a small file with one line for
each run (runs grow with the logarithm of the data, not with it): the version is claimed by an
exclusive create, written beside and moved in place by one rename, so readers see a whole version or
none, and a writer that was overtaken fails and may try again. A claim whose writer died expires after
``CLAIM_SECONDS``; a writer moves its version in place only in the first half of that time. Compaction
deletes nothing: old versions stay readable until ``vacuum``, which spares what is younger than its
grace period, such as the runs of an append that is not yet committed.

Rows are stored as they come: nulls, empty and very long texts, repeated rows and extra columns
included. An empty arrival commits nothing; an empty store reads as an empty table with the schema it
was opened with.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.llm.common import file_system

TARGET_BYTES, FAN_IN, TIER_LEAST = 128 << 20, 4, 1 << 20
#: Seconds until a claim without a version expires, and for which vacuum spares what nothing refers to.
CLAIM_SECONDS, GRACE_SECONDS = 600, 24 * 3600


@dataclass(frozen=True)
class Run:
    """A folder of files: name, bytes, number of files, merges it has been through."""

    name: str
    size: int
    files: int
    merges: int


class Conflict(RuntimeError):
    """Another writer committed first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, claim_seconds: float = CLAIM_SECONDS):
        self.claim_seconds = claim_seconds
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fan_in = target_bytes, fan_in
        self.fs, _ = file_system(spark, self.root)

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    # -- the manifest ------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def runs(self, version: int | None = None) -> list[Run]:
        known = self.versions()
        if not known:
            return []
        if version == 0:
            return []
        name = f"v{known[-1] if version is None else version:010d}.json"
        stream = self.fs.open(self._path("manifest", name))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**json.loads(line)) for line in text.splitlines() if line]

    def _commit(self, base: int, runs: list[Run]) -> int:
        """Version base + 1 with these runs; ``Conflict`` if it is taken."""
        version = base + 1
        claim = self._path("manifest", f"v{version:010d}.claim")
        try:
            self.fs.create(claim, False).close()
        except Exception as e:
            self._expire(version, claim)
            raise Conflict(f"version {version} is taken") from e
        claimed = time.monotonic()
        side = self._path("manifest", f".{uuid.uuid4().hex}")
        out = self.fs.create(side, False)
        try:
            out.write(bytearray("".join(json.dumps(asdict(r)) + "\n" for r in runs), "utf-8"))
        finally:
            out.close()
        if time.monotonic() - claimed > self.claim_seconds / 2:  # another writer may soon take it for dead
            self.fs.delete(side, False)
            raise Conflict(f"version {version} took too long")
        if not self.fs.rename(side, self._path("manifest", f"v{version:010d}.json")):
            raise Conflict(f"version {version} could not be moved in place")
        return version

    def _expire(self, version: int, claim) -> None:
        """Deletes a claim whose writer never committed and is out of its time."""
        if self.fs.exists(self._path("manifest", f"v{version:010d}.json")) or not self.fs.exists(claim):
            return
        if time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000 > self.claim_seconds:
            self.fs.delete(claim, False)

    def _latest(self) -> int:
        return (self.versions() or [0])[-1]

    def _measured(self, name: str, merges: int) -> Run:
        files = [s for s in self.fs.listStatus(self._path("runs", name)) if s.getPath().getName().startswith("part-")]
        return Run(name, sum(s.getLen() for s in files), len(files), merges)

    # -- appending ---------------------------------------------------------------------------------
    def append(self, df: DataFrame) -> int | None:
        """One arrival as a run; the version that has it."""
        name = uuid.uuid4().hex
        df.select(*[F.col(f"`{f.name}`") for f in self.schema]).write.parquet(f"{self.root}/runs/{name}")
        return self._add([name])

    def append_each(self, df: DataFrame, arrival: Column) -> int | None:
        """Many arrivals, told apart by a column, written in one pass; a run for each."""
        key = "__arrival"
        name = uuid.uuid4().hex
        df.select(*[F.col(f"`{f.name}`") for f in self.schema], arrival.alias(key)).write.partitionBy(key).parquet(f"{self.root}/runs/{name}")
        folders = [s.getPath().getName() for s in self.fs.listStatus(self._path("runs", name)) if s.isDirectory()]
        return self._add([f"{name}/{x}" for x in sorted(folders)])

    def _add(self, names: list[str]) -> int | None:
        new = [r for r in (self._measured(n, 0) for n in names) if r.files]
        if not new:
            return None
        waited = time.monotonic()
        while True:
            base = self._latest()
            try:
                return self._commit(base, [*self.runs(base), *new])
            except Conflict:
                if self._latest() == base:  # claimed, but not yet written; a dead writer's claim expires meanwhile
                    if time.monotonic() - waited > 2 * self.claim_seconds:
                        raise
                    time.sleep(min(1.0, self.claim_seconds / 10))

    # -- compaction --------------------------------------------------------------------------------
    def finished(self, r: Run) -> bool:
        return r.size >= r.files * self.target // 2 and r.size >= self.target // 2

    def tier(self, r: Run) -> int:
        """Runs of a tier differ in size by a factor of ``fan_in`` at most."""
        return max(0, math.floor(math.log(max(r.size, 1) / TIER_LEAST, self.fan_in))) if r.size > TIER_LEAST else 0

    def next_merge(self, runs: list[Run]) -> list[Run]:
        """The runs of the lowest tier that is full; of its runs the smallest; none if no tier is full."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if not self.finished(r):
                tiers.setdefault(self.tier(r), []).append(r)
        for t in sorted(tiers):
            if len(tiers[t]) >= self.fan_in:
                return sorted(tiers[t], key=lambda r: (r.size, r.name))[: self.fan_in]
        return []

    def compact(self) -> int:
        """Merges until no tier is full; the last version. What appends commit meanwhile is kept; what a merge replaced stays until ``vacuum``."""
        while merging := self.next_merge(self.runs()):
            name, gone = uuid.uuid4().hex, {r.name for r in merging}
            files = max(1, round(sum(r.size for r in merging) / self.target))
            self._read(merging).coalesce(files).write.parquet(f"{self.root}/runs/{name}")
            self._replace(gone, self._measured(name, max(r.merges for r in merging) + 1))
        return self._latest()

    def _replace(self, gone: set[str], merged: Run) -> None:
        """Commits a merged run in place of others, if they are all still there; else another compaction was first, and the merge is dropped."""
        waited = time.monotonic()
        while True:
            base = self._latest()
            now = self.runs(base)
            if not gone <= {r.name for r in now}:
                return
            try:
                self._commit(base, [*(r for r in now if r.name not in gone), merged])
                return
            except Conflict:
                if self._latest() == base:
                    if time.monotonic() - waited > 2 * self.claim_seconds:
                        raise
                    time.sleep(min(1.0, self.claim_seconds / 10))

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> None:
        """Deletes versions that were replaced before the grace period, and runs that no version left has and that are as old."""
        before = (time.time() - grace_seconds) * 1000
        known = self.versions()
        written = {v: self.fs.getFileStatus(self._path("manifest", f"v{v:010d}.json")).getModificationTime() for v in known}
        stay = [v for v, after in zip(known, known[1:]) if written[after] >= before] + known[-1:]
        live = {r.name for v in stay for r in self.runs(v)}
        for v in set(known) - set(stay):
            for kind in ("json", "claim"):
                self.fs.delete(self._path("manifest", f"v{v:010d}.{kind}"), False)
        runs = self._path("runs")
        for s in self.fs.listStatus(runs) if self.fs.exists(runs) else []:
            top = s.getPath().getName()
            inner = [f"{top}/{x.getPath().getName()}" for x in self.fs.listStatus(s.getPath()) if x.isDirectory()]
            for name in [n for n in inner if n not in live]:
                if self._newest(name) < before:
                    self.fs.delete(self._path("runs", name), True)
            if top not in live and not any(n.startswith(f"{top}/") for n in live) and self._newest(top) < before:
                self.fs.delete(s.getPath(), True)

    def _newest(self, name: str) -> int:
        """When the last file of a run was written."""
        times, files = [self.fs.getFileStatus(self._path("runs", name)).getModificationTime()], self.fs.listFiles(self._path("runs", name), True)
        while files.hasNext():
            times.append(files.next().getModificationTime())
        return max(times)

    # -- reading -----------------------------------------------------------------------------------
    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/runs/{r.name}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; by default the latest."""
        return self._read(self.runs(version))
