"""Size-tiered compaction of an append-only set of shards, with versioned manifests.

Arrivals are appended as small immutable Parquet shards.  A compaction looks at the live shards, takes those below
the target size tier by tier (a tier holds sizes within a factor of ``FACTOR`` of its smallest), and merges runs of one
tier into files of about the target size; a tier with fewer than ``FAN_IN`` runs waits.  Every change is
committed by renaming a finished manifest to the next version's name, which succeeds for one writer only where renaming is atomic (HDFS
and local disks; an object store needs a committer with conditional puts).
Shards that no manifest names are leftovers of a failed writer and are removed by :meth:`ShardStore.vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_path

TARGET_BYTES, FAN_IN, FACTOR, CODEC = 128 << 20, 4, 4, "zstd"
#: Merges written by one job, and jobs that run at once.
MERGES_PER_JOB, JOBS = 64, 16
#: Seconds for which a shard that no manifest names may still belong to a writer at work.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, factor: int = FACTOR):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan_in, self.factor = target_bytes, fan_in, factor
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        for x in ("manifests", "shards"):
            self.fs.mkdirs(self._path(x))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # manifests

    def versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()[:-5]) for x in self.fs.listStatus(self._path("manifests")) if x.getPath().getName()[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last; version 0 has no shards."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"manifests/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, schema: str, shards: list[dict], what: str) -> dict:
        """Make ``shards`` the version after ``base``; Conflict if that version exists."""
        new = {"version": base["version"] + 1, "what": what, "schema": schema, "shards": sorted(shards, key=lambda x: x["name"])}
        draft, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{new['version']:010d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {new['version']} was committed by another writer")
        return new

    # writing

    def _written(self, run: str) -> list[dict]:
        """The non-empty shards that a run has written."""
        files = self.fs.listStatus(self._path(f"shards/{run}"))
        return [{"name": f"{run}/{x.getPath().getName()}", "bytes": x.getLen(), "run": run} for x in files if x.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> dict:
        """Write an arrival as small shards, one for each of its partitions, and commit them."""
        run = f"a-{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).parquet(f"{self.path}/shards/{run}")
        return self._retry(lambda base: self.commit(base, df.schema.json(), base["shards"] + self._written(run), "append"))

    def _retry(self, change):
        while True:
            try:
                return change(self.manifest())
            except Conflict:
                continue

    def tiers(self, shards: list[dict]) -> list[list[dict]]:
        """Shards below half the target, in runs of sizes within ``factor`` of the smallest of the run."""
        runs: list[list[dict]] = []
        for x in sorted(shards, key=lambda x: (x["bytes"], x["name"])):
            if x["bytes"] < self.target // 2:
                if not runs or x["bytes"] > self.factor * runs[-1][0]["bytes"]:
                    runs.append([])
                runs[-1].append(x)
        return runs

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The merges to do: shards of similar size, together about the target size."""
        merges = []
        for runs in self.tiers(shards):
            if len(runs) < self.fan_in:
                continue
            group, size = [], 0
            for x in runs:
                if group and size + x["bytes"] > self.target:
                    merges.append(group)
                    group, size = [], 0
                group.append(x)
                size += x["bytes"]
            if len(group) >= self.fan_in:
                merges.append(group)
        return [x for x in merges if len(x) > 1]

    def compact(self) -> dict:
        """Merge until no tier has ``fan_in`` runs to merge; commits a version for each round."""
        while True:
            base = self.manifest()
            merges = self.plan(base["shards"])
            if not merges:
                return base
            schema = _schema(base["schema"])

            def merge(groups: list, schema=schema) -> list[dict]:
                run = f"m-{uuid.uuid4().hex}"
                parts = [self.spark.read.schema(schema).parquet(*(f"{self.path}/shards/{x['name']}" for x in group)).coalesce(1) for group in groups]
                reduce(DataFrame.union, parts).write.option("compression", CODEC).parquet(f"{self.path}/shards/{run}")
                return self._written(run)

            with ThreadPoolExecutor(JOBS) as pool:  # the jobs of a round run side by side
                new = [x for found in pool.map(merge, [merges[i : i + MERGES_PER_JOB] for i in range(0, len(merges), MERGES_PER_JOB)]) for x in found]
            gone = {x["name"] for group in merges for x in group}

            def swap(now: dict, gone=gone, new=new) -> dict:
                if not gone <= {x["name"] for x in now["shards"]}:
                    raise RuntimeError("another compaction has merged the same shards")
                return self.commit(now, now["schema"], [x for x in now["shards"] if x["name"] not in gone] + new, "compact")

            self._retry(swap)

    def vacuum(self, keep_versions: int = 1, grace: float = GRACE) -> list[str]:
        """Remove shards that none of the last ``keep_versions`` manifests names, and older manifests.

        A shard younger than ``grace`` seconds stays, as a writer may be about to commit it: no append or merge may take longer.
        """
        before = 1000 * (time.time() - grace)
        versions = self.versions()
        kept = {x["name"] for v in versions[-keep_versions:] for x in self.manifest(v)["shards"]}
        gone = []
        for run in self.fs.listStatus(self._path("shards")):
            for x in self.fs.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{x.getPath().getName()}"
                if name.endswith(".parquet") and name not in kept and x.getModificationTime() <= before:
                    self.fs.delete(x.getPath(), False)
                    gone.append(name)
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path(f"manifests/{v:010d}.json"), False)
        return gone

    # reading

    def read(self, version: int | None = None, names: bool = False) -> DataFrame:
        """All rows of a version; ``names`` adds the shard of each as column ``_shard``."""
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing was appended")
        schema = _schema(m["schema"])
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*(f"{self.path}/shards/{x['name']}" for x in m["shards"]))
        return df.withColumn("_shard", F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)$", 1)) if names else df


def _schema(text: str):
    return StructType.fromJson(json.loads(text))


def compacted(docs: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append ``docs`` in ``arrivals`` batches, compact, and read the result back with the shard of each row.

    Returns doc_id, text_bytes, text_hash, shard, shard_bytes, version: a row for each row, repeated ones included.  Null and
    empty texts, long texts and further columns are stored as they are.  Arrivals are dealt by a hash of
    the row.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, new_path(spark, "shards"), target_bytes)
    number = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(number == i))
    store.compact()
    store.vacuum(grace=-60)  # the only writer has ended
    m = store.manifest()
    sizes = spark.createDataFrame([(x["name"], x["bytes"]) for x in m["shards"]], "_shard string, shard_bytes long")
    rows = store.read(names=True).select(F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"), F.xxhash64("text").alias("text_hash"), "_shard")
    rows = rows.join(F.broadcast(sizes), "_shard", "left")  # the driver holds the manifest anyway
    return rows.select("doc_id", "text_bytes", "text_hash", F.col("_shard").alias("shard"), "shard_bytes", F.lit(m["version"]).alias("version"))
