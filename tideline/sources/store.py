"""A persisted store: sorted runs as Parquet, and a manifest of those in use.

Writes gather in the buffer, which is kept as runs of level 0, so nothing is lost
with the driver. When it holds ``flush_every`` records it becomes one run of level
1, after full levels have been merged down. Runs are immutable; a manifest version
lists the runs in use and is a file that no one may overwrite. What a version
retires stays for ``KEEP`` more versions, so a reader that has opened an older
one, or a crash at any point, finds a whole state. One writer at a time; another
one that publishes the same version is refused.

Runs are sorted by key within files of disjoint key ranges and carry Bloom
filters, so Parquet's statistics prune range reads and its filters point reads.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import latest, live
from .config import Config

_SCHEMA = "key int, is_delete boolean, value int"
#: Versions for which retired runs and old manifests stay.
KEEP = 3


@dataclass(frozen=True)
class Run:
    level: int
    run_id: int
    size: int
    delete_count: int
    min_key: int | None
    max_key: int | None


@dataclass
class Manifest:
    version: int = 0
    next_run: int = 0
    #: Levels that exist, also empty ones.
    depth: int = 0
    runs: list[Run] = field(default_factory=list)
    #: Runs no longer in use: number, and the version that retired it.
    retired: list[tuple[int, int]] = field(default_factory=list)


class Files:
    """What the store needs of a file system, whichever Hadoop knows for the path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a file, unless there is one of its name."""
        try:
            stream = self.fs.create(self._path(path), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class Store:
    """``Store(spark, root)`` opens or starts the store in a folder. ``flush_every``
    (records of the buffer) comes from the configuration unless given."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, files_per_run: int | None = None, flush_every: int | None = None) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.files_per_run = files_per_run
        self.flush_every = flush_every or self.config.flush_every
        self.files = Files(spark, self.root)

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for x in self.files.names(f"{self.root}/manifest") if (m := re.fullmatch(r"v(\d+)\.json", x)))

    def manifest(self) -> Manifest:
        """The newest version that is whole."""
        for v in reversed(self._versions()):
            try:
                raw = json.loads(self.files.read(f"{self.root}/manifest/v{v}.json"))
            except ValueError:
                continue  # its writer died over it
            return Manifest(raw["version"], raw["next_run"], raw["depth"], [Run(**r) for r in raw["runs"]], [tuple(r) for r in raw["retired"]])
        return Manifest()

    def _publish(self, m: Manifest) -> None:
        """The next version; then what was retired long ago is deleted."""
        m.version = 1 + max([m.version, *self._versions()])
        gone = [r for r, version in m.retired if version and version + KEEP < m.version]
        m.retired = [(r, version or m.version) for r, version in m.retired if r not in gone]
        text = json.dumps({"version": m.version, "next_run": m.next_run, "depth": m.depth, "runs": [asdict(r) for r in m.runs], "retired": m.retired})
        if not self.files.write_new(f"{self.root}/manifest/v{m.version}.json", text):
            raise RuntimeError(f"another writer has published version {m.version}")
        for run_id in gone:
            self.files.delete(f"{self.root}/runs/run={run_id}")
        for v in self._versions():
            if v + KEEP < m.version:
                self.files.delete(f"{self.root}/manifest/v{v}.json")

    def _path(self, run: Run) -> str:
        return f"{self.root}/runs/run={run.run_id}"

    def _capacity(self, level: int) -> int:
        """Records that a run of a level holds at most, if batches fit the buffer."""
        unit = 1 if level < 2 else 2 * self.config.ratio ** (level - 1)
        return min(self.flush_every * unit, (1 << 31) - 1)

    def _write_run(self, records: DataFrame, level: int, run_id: int) -> Run:
        path = f"{self.root}/runs/run={run_id}"
        n = self.files_per_run
        parted = records.repartitionByRange(n, "key") if n else records.repartitionByRange("key")
        (
            parted.sortWithinPartitions("key")
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#key", "true")
            .option("parquet.bloom.filter.fpp#key", str(self.config.fp_rate))
            .option("parquet.bloom.filter.expected.ndv#key", str(self._capacity(level)))
            .option("parquet.enable.dictionary#key", "false")
            .parquet(path)
        )
        s = self.spark.read.schema(_SCHEMA).parquet(path).agg(F.count(F.lit(1)), F.count_if("is_delete"), F.min("key"), F.max("key")).first()
        return Run(level, run_id, s[0], s[1], s[2], s[3])

    def _read(self, runs: list[Run]) -> DataFrame:
        """``key, is_delete, value, recency, level, run_id`` of runs: shallower
        levels are newer, and within a level higher run ids."""
        if not runs:
            return self.spark.createDataFrame([], f"{_SCHEMA}, recency long, level int, run_id long")
        found = self.spark.read.schema(f"{_SCHEMA}, run long").option("basePath", f"{self.root}/runs").parquet(*(self._path(r) for r in runs))
        known = self.spark.createDataFrame([(r.run_id, r.level) for r in runs], "run_id long, level int")
        found = found.withColumnRenamed("run", "run_id").join(F.broadcast(known), "run_id")  # a row per run
        return found.withColumn("recency", F.col("run_id") - F.col("level").cast("long") * (1 << 40))

    def _merge(self, m: Manifest, level: int) -> None:
        """The runs of a level as one run of the next."""
        inputs = [r for r in m.runs if r.level == level]
        if len(inputs) == 1 and level == 0:
            merged = replace(inputs[0], level=1)
        else:
            merged = self._write_run(latest(self._read(inputs), "recency"), level + 1, m.next_run)
            m.next_run += 1
            m.retired += [(r.run_id, 0) for r in inputs]
        m.depth = max(m.depth, level + 1)
        m.runs = [r for r in m.runs if r.level != level] + [merged]

    def flush(self, m: Manifest | None = None) -> None:
        """Make the buffer a run of level 1, whatever it holds."""
        own = m or self.manifest()
        if any(r.level == 0 for r in own.runs):
            full = 0
            while sum(r.level == full + 1 for r in own.runs) >= self.config.ratio * (2 if full == 0 else 1):
                full += 1
            for level in range(full, -1, -1):
                self._merge(own, level)
            if m is None:
                self._publish(own)

    def write(self, ops: DataFrame) -> None:
        """Take in a batch of operations (``seq, key, is_delete, value``), newer
        than all before. The buffer is flushed when it is full; a batch that is
        larger than the buffer is one run all the same."""
        m = self.manifest()
        m.runs.append(self._write_run(latest(ops), 0, m.next_run))
        m.next_run += 1
        if sum(r.size for r in m.runs if r.level == 0) >= self.flush_every:
            self.flush(m)
        self._publish(m)

    def held(self) -> DataFrame:
        """All records of all runs."""
        return self._read(self.manifest().runs)

    def state(self) -> DataFrame:
        """``key, value`` of the live keys; filters on key reach the runs' scans."""
        return live(latest(self.held(), "recency"))

    def get(self, key: int) -> int | None:
        """The value of a key, or None. Runs whose key range excludes it are not read."""
        runs = [r for r in self.manifest().runs if r.min_key is not None and r.min_key <= key <= r.max_key]
        row = live(latest(self._read(runs).where(F.col("key") == key), "recency")).first()
        return row and row["value"]

    def range(self, lo: int, hi: int) -> DataFrame:
        runs = [r for r in self.manifest().runs if r.min_key is not None and r.min_key < hi and r.max_key >= lo]
        found = self._read(runs).where((F.col("key") >= lo) & (F.col("key") < hi))
        return live(latest(found, "recency")).orderBy("key")

    def level_pairs(self) -> dict[int, int]:
        """Live records per level, from the manifest alone; empty levels too, and
        the buffer (level 0) where it has any."""
        m = self.manifest()
        found = {k: sum(r.size - r.delete_count for r in m.runs if r.level == k) for k in range(m.depth + 1)}
        return {k: n for k, n in found.items() if k or n}

    def clear(self) -> None:
        self.files.delete(self.root)
