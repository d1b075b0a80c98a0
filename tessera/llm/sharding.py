"""Sharded tables with size-tiered compaction and atomic versions.

Arrivals are appended as small immutable shards.  A manifest, one immutable
folder for each version, says which shards the version adds and takes away; it is
written under a draft name and committed by one rename, which fails if another
writer has taken the version.  Every FOLD versions a folder lists all shards, from
which readers go on.  Compaction puts shards into tiers by the logarithm of their size,
merges runs of similar size into files of about the target size, wave by wave,
and commits each wave; a reader sees a whole version, before or after.

The data path is DataFrame reading and writing; no rows pass through Python and
nothing is shuffled, as a merged file is one task that reads its run."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import cut, forget, fresh, hadoop_path, written

TARGET = 128 << 20
#: Shards of one tier that make a run worth merging.
FANOUT = 4
#: Rows of an arriving shard at most.
ARRIVAL_ROWS = 4000
#: Merged files that one job writes.
WAVE = 256
#: Shards of a tier that one task plans, about.
PART = 50_000
#: Versions after which the manifest is written whole.
FOLD = 64
_COLUMNS = "path string, bytes long, n_rows long, added long"
_CHANGES = f"{_COLUMNS}, gone boolean"


class Shards:
    """A sharded table below *root*, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, wave: int = WAVE):
        self.spark, self.root, self.target, self.fanout, self.wave = spark, root.rstrip("/"), target, fanout, wave

    # --- versions

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        fs, path = hadoop_path(self.spark, f"{self.root}/manifest")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(x[1:]) for x in names if x.startswith("v")), default=0)

    def _folded(self, version: int) -> int:
        """The newest version up to this one that is listed whole; 0 if none is."""
        fs, path = hadoop_path(self.spark, f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((v for v in (int(x[1:]) for x in names if x.startswith("s")) if v <= version), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, n_rows and the version that added each shard: the newest
        whole list and what the versions after it changed."""
        version = self.version() if version is None else version
        start = self._folded(version)
        changes = [f"{self.root}/manifest/v{v:08d}" for v in range(start + 1, version + 1)]  # FOLD at most, if all were folded
        whole = [f"{self.root}/manifest/s{start:08d}"] if start else []
        if not changes + whole:
            return self.spark.createDataFrame([], _COLUMNS)
        rows = self.spark.read.schema(_CHANGES).parquet(*whole, *changes)
        if not changes:
            return rows.drop("gone")
        # a path is added once and may go once
        live = rows.groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("n_rows").alias("n_rows"), F.max("added").alias("added"), F.bool_or("gone").alias("gone"))
        return live.where("not gone").drop("gone")

    def _commit(self, added: DataFrame, gone: list[str], version: int) -> int:
        """Commits what a version adds and takes away, in proportion to that."""
        rows = added.select("path", "bytes", "n_rows", "added", F.lit(False).alias("gone"))
        if gone:
            old = self.spark.createDataFrame([(p,) for p in gone], "path string")  # of one wave
            rows = rows.unionByName(old.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        self._publish(rows.coalesce(1), f"v{version:08d}", f"version {version} was committed by another writer")
        if version - self._folded(version) >= FOLD:
            self.fold(version)
        return version

    def fold(self, version: int | None = None) -> None:
        """Writes a version's list of shards whole; readers of later ones start there."""
        version = self.version() if version is None else version
        if version and self._folded(version) < version:
            self._publish(self.manifest(version).withColumn("gone", F.lit(False)), f"s{version:08d}", None)

    def _publish(self, rows: DataFrame, name: str, taken: str | None) -> None:
        draft = f"{self.root}/manifest/draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        fs, a = hadoop_path(self.spark, draft)
        _, b = hadoop_path(self.spark, f"{self.root}/manifest/{name}")
        if fs.exists(b) or not fs.rename(a, b) or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(b, a.getName())):
            if taken:
                raise RuntimeError(taken)
            fs.delete(a, True)  # the same list is there

    def _described(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the shards that a job has written to *folder*."""
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return files.groupBy("path", "bytes").agg(F.count("*").alias("n_rows")).withColumn("added", F.lit(version).cast("long"))

    # --- writing

    def append(self, rows: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Adds rows as small shards and commits; returns the version. Nothing to
        add still makes a version; the schema must stay the same."""
        version = self.version() + 1
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(folder)
        fs, p = hadoop_path(self.spark, f"{self.root}/schema.json")
        if not fs.exists(p):
            out = fs.create(p)
            out.write(bytearray(rows.schema.json().encode()))
            out.close()
        return self._commit(self._described(folder, version), [], version)

    def plan(self) -> DataFrame:
        """The runs to merge: manifest rows with tier, part and run. Shards of half
        the target or more are done. A tier with very many shards is planned in parts
        of about PART shards. A run takes shards of one part, by size, up to the
        target; it is merged if it has *fanout* shards or fills half of it."""
        small = self.manifest().where(F.col("bytes") < self.target / 2)
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / math.log(self.fanout))
        small = small.withColumn("tier", tier)
        parts = small.groupBy("tier").agg((1 + F.floor(F.count("*") / PART)).alias("parts"))  # a row for each tier
        dealt = small.join(F.broadcast(parts), "tier").withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")))
        order = Window.partitionBy("tier", "part").orderBy("bytes", "path")
        before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
        placed = dealt.withColumn("run", F.floor(F.coalesce(before, F.lit(0)) / self.target))
        run = Window.partitionBy("tier", "part", "run")
        sized = placed.withColumn("k", F.count("*").over(run)).withColumn("size", F.sum("bytes").over(run))
        return sized.where((F.col("k") > 1) & ((F.col("k") >= self.fanout) | (F.col("size") >= self.target / 2))).select("path", "bytes", "n_rows", "added", "tier", "part", "run")

    def compact(self) -> int:
        """Merges until no run is left; returns the version. The driver holds the
        names of one wave's small files at a time; a commit is as large as its wave."""
        while True:
            name = F.format_string("%06d-%012d-%012d", "tier", "part", "run").alias("name")
            plan, path = written(self.plan().select(name, "path", "n_rows"), "plan")
            runs = plan.select("name").distinct().orderBy("name")
            done = ""
            while keys := [r["name"] for r in runs.where(F.col("name") > done).limit(self.wave).collect()]:
                wave = plan.where(F.col("name").between(keys[0], keys[-1]))
                groups: dict[str, list[str]] = {}
                n_rows = 0
                for r in wave.orderBy("name", "path").collect():
                    groups.setdefault(r["name"], []).append(r["path"])
                    n_rows += r["n_rows"]
                self._merge(list(groups.values()), n_rows)
                done = keys[-1]
            forget(path)
            if not done:
                return self.version()

    def _merge(self, groups: list[list[str]], before: int) -> None:
        version = self.version() + 1
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        merged = None
        for paths in groups:
            one = self.spark.read.schema(self.schema()).parquet(*paths).coalesce(1)
            merged = one if merged is None else merged.union(one)
        # a union of single partitions must stay as many tasks, each with its own file
        key = "spark.sql.unionOutputPartitioning"
        was = self.spark.conf.get(key, "true")
        self.spark.conf.set(key, "false")
        try:
            merged.write.option("compression", "zstd").parquet(folder)
        finally:
            self.spark.conf.set(key, was)
        added = self._described(folder, version)
        after = added.agg(F.sum("n_rows")).first()[0]
        if before != after:
            raise RuntimeError(f"merging changed {before} rows to {after}")
        self._commit(added, [p for g in groups for p in g], version)

    def vacuum(self) -> None:
        """Deletes shards and versions that the newest version doesn't need. Only
        safe once no reader uses an older one."""
        newest = self.version()
        self.fold(newest)
        folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
        live = self.manifest().select(folder.alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
        kept = {r["folder"] for r in live.select("folder").distinct().collect()}  # one for each version at most
        fs, data = hadoop_path(self.spark, f"{self.root}/data")
        for d in fs.listStatus(data) if fs.exists(data) else []:
            own = d.getPath().getName()
            if own not in kept:
                fs.delete(d.getPath(), True)
                continue
            names = {r["name"] for r in live.where(F.col("folder") == own).select("name").collect()}  # of one folder
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().endswith(".parquet") and f.getPath().getName() not in names:
                    fs.delete(f.getPath(), False)
        _, versions = hadoop_path(self.spark, f"{self.root}/manifest")
        for v in fs.listStatus(versions):
            if v.getPath().getName() not in (f"v{newest:08d}", f"s{newest:08d}"):
                fs.delete(v.getPath(), True)

    # --- reading

    def schema(self):
        text = self.spark.read.text(f"{self.root}/schema.json", wholetext=True).first()[0]
        return StructType.fromJson(json.loads(text))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. The driver names the folders that hold its shards, one
        for each write; where a folder has others too, which a vacuum deletes, its files
        are held against the manifest."""
        live = cut(self.manifest(version).select("path", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder")), "live")
        held = {r["folder"]: r["n"] for r in live.groupBy("folder").agg(F.count("*").alias("n")).collect()}
        fs, _ = hadoop_path(self.spark, self.root)
        there = {f: sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(hadoop_path(self.spark, f)[1])) for f in held}
        schema, out = self.schema(), None
        for folders, whole in (([f for f in sorted(held) if held[f] == there[f]], True), ([f for f in sorted(held) if held[f] != there[f]], False)):
            if not folders:
                continue
            rows = self.spark.read.schema(schema).parquet(*folders)
            if not whole:
                (own,) = fresh(rows, "file_path")
                rows = rows.withColumn(own, F.col("_metadata.file_path")).join(live.select(F.col("path").alias(own)), own, "left_semi").drop(own)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out


def compacted(docs: DataFrame, root: str, target: int = TARGET, shard_rows: int = ARRIVAL_ROWS) -> Shards:
    """Appends *docs* (any columns, nulls and repeated rows as they are) to the
    table at *root*, compacts and cleans up."""
    table = Shards(docs.sparkSession, root, target)
    table.append(docs, shard_rows)
    table.compact()
    table.vacuum()
    return table
