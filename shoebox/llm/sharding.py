"""Shards by size-tiered compaction.

Arrivals are appended as small shards that never change. Runs of similar size are merged into files
of about the target size, in one pass that moves no row over the network: Spark's scan packs the small
files of a run into tasks of the target size, and each task writes one file. What is current is told
by the manifest of the highest version; committing one is a rename that fails if the version exists.
Only DataFrame functions touch rows.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import filesystem, free_names, work_path

TARGET_BYTES = 128 << 20
#: Runs of similar size that are merged once there are so many.
MIN_RUNS = 4
#: A run belongs to a tier if it is between these multiples of the tier's mean size.
ALIKE = (0.5, 1.5)


class ShardStore:
    """A versioned set of Parquet shards under `path`."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, min_runs: int = MIN_RUNS):
        self.spark, self.path, self.target, self.min_runs = spark, path, target_bytes, min_runs

    # what is current

    def version(self) -> int:
        """The highest committed version; 0 for a store without arrivals."""
        fs, folder = filesystem(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "runs": [{"name", "tier", "files": [[name, bytes], ...]}]}."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        fs, p = filesystem(self.spark, f"{self.path}/manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, old: dict, runs: list[dict], schema: dict) -> int:
        """Makes the next version current, or fails if another writer has."""
        version = old["version"] + 1
        fs, draft = filesystem(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "runs": runs}).encode()))
        out.close()
        _, final = filesystem(self.spark, f"{self.path}/manifests/{version:012d}.json")
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        plain = context._gateway.new_array(hadoop.Options.Rename, 1)
        plain[0] = hadoop.Options.Rename.NONE  # fails if the version is there
        try:
            hadoop.FileContext.getFileContext(final.toUri(), context._jsc.hadoopConfiguration()).rename(draft, final, plain)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} could not be committed; another writer may have") from error
        return version

    def _files(self, run: str) -> list[list]:
        fs, folder = filesystem(self.spark, f"{self.path}/runs/{run}")
        if not fs.exists(folder):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder)]
        return [[n, size] for n, size in sorted(found) if n.startswith("part-")]

    def paths(self, runs: list[dict]) -> list[str]:
        return [f"{self.path}/runs/{r['name']}/{n}" for r in runs for n, _ in r["files"]]

    # reading and writing

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as a run of its own, one small shard per task; returns the version. An arrival without rows is a run without rows."""
        old = self.manifest()
        schema = self._schema(rows, old)
        name = f"arrival-{old['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/runs/{name}")
        return self._commit(old, [*old["runs"], {"name": name, "tier": 0, "files": self._files(name)}], schema)

    def append_each(self, rows: DataFrame, arrival_col: str, arrivals: int) -> int:
        """Adds the rows whose arrival_col is 0, those where it is 1, and so on up to `arrivals`, each as a run and a version of its own, from one read of them all; the column isn't stored."""
        schema = self._schema(rows.drop(arrival_col), self.manifest())
        name = f"arrivals-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy(arrival_col).parquet(f"{self.path}/runs/{name}")
        for k in range(arrivals):
            old, run = self.manifest(), f"{name}/{arrival_col}={k}"
            self._commit(old, [*old["runs"], {"name": run, "tier": 0, "files": self._files(run)}], schema)
        return self.version()

    @staticmethod
    def _schema(rows: DataFrame, old: dict) -> dict:
        schema = json.loads(rows.schema.json())
        for field in schema["fields"]:
            field["nullable"] = True
        if old["schema"] and old["schema"] != schema:
            raise ValueError("the arrival's columns differ from the store's")
        return schema

    def tiers(self, runs: list[dict]) -> list[list[dict]]:
        """Runs of similar size together, the smaller first; runs that are files of the target size already take no part."""
        open_ = sorted((r for r in runs if self._unfinished(r)), key=lambda r: (run_bytes(r), r["name"]))
        out: list[list[dict]] = []
        for run in open_:
            mean = sum(map(run_bytes, out[-1])) / len(out[-1]) if out else 0
            if out and (ALIKE[0] * mean <= run_bytes(run) <= ALIKE[1] * mean or run_bytes(run) == mean):
                out[-1].append(run)
            else:
                out.append([run])
        return out

    def _unfinished(self, run: dict) -> bool:
        return len(run["files"]) > max(1, math.ceil(run_bytes(run) / self.target)) or run_bytes(run) < self.target

    def compact(self) -> int:
        """Merges each tier of enough runs, again until none is left; returns the version.

        Each merge is one commit. A writer that fails before it leaves files that no manifest names.
        Readers of an older version keep their files until remove_unused().
        """
        while True:
            old = self.manifest()
            due = next((t for t in self.tiers(old["runs"]) if len(t) >= self.min_runs), None)
            if due is None:
                return old["version"]
            name = f"merged-{old['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            session = self.spark.newSession()  # the packing of files is set for this scan alone
            session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
            session.conf.set("spark.sql.files.openCostInBytes", "0")
            session.conf.set("spark.sql.files.minPartitionNum", "1")
            rows = self._read(session, due, old["schema"])
            rows.write.parquet(f"{self.path}/runs/{name}")
            merged = {"name": name, "tier": 1 + max(r["tier"] for r in due), "files": self._files(name)}
            gone = {r["name"] for r in due}
            self._commit(old, [*(r for r in old["runs"] if r["name"] not in gone), merged], old["schema"])

    def remove_unused(self) -> list[str]:
        """Deletes the runs that the current version doesn't name; returns their names. Not while a writer is at work."""
        fs, folder = filesystem(self.spark, f"{self.path}/runs")
        current = {r["name"] for r in self.manifest()["runs"]}
        gone = {}
        for top in fs.listStatus(folder):
            name = top.getPath().getName()
            inside = [s.getPath() for s in fs.listStatus(top.getPath()) if s.isDirectory()]
            runs = {f"{name}/{p.getName()}": p for p in inside} or {name: top.getPath()}
            unused = {n: p for n, p in runs.items() if n not in current}
            gone |= unused if len(unused) < len(runs) or not inside else unused | {name: top.getPath()}
        for name in sorted(gone):
            fs.delete(gone[name], True)
        return sorted(gone)

    def _read(self, session: SparkSession, runs: list[dict], schema: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        paths = self.paths(runs)
        kind = StructType.fromJson(schema)
        return session.read.schema(kind).parquet(*paths) if paths else session.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default."""
        old = self.manifest(version)
        if old["schema"] is None:
            raise ValueError("the store has no arrivals")
        return self._read(self.spark, old["runs"], old["schema"])


def run_bytes(run: dict) -> int:
    return sum(size for _, size in run["files"])


def shard_arrivals(docs: DataFrame, arrivals: int, id_col: str = "doc_id", target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Stores docs as so many arrivals, dealt by the hash of the id (null ids come first), and compacts them.

    Rows are stored whole with all their columns, repeated ones as often as they come. An empty table
    gives empty runs.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, work_path(spark, "shards"), target_bytes)
    arrival = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(arrivals)), F.lit(0))
    (name,) = free_names(docs, "arrival")
    store.append_each(docs.withColumn(name, arrival), name, arrivals)
    store.compact()
    store.remove_unused()
    return store
