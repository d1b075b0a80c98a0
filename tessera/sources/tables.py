"""Reading and writing rollout tables."""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schemas import normalised
from tessera.storage import forget, hadoop_path, written

#: (pattern of a source's name, split to read); the first that matches holds. Programs
#: differ: most read the train split of prefixed sets, the environment never a test
#: split.
ROUTES = (("train-", "train"), ("lcb", "test"), ("", "code"))
ENVIRONMENT_ROUTES = (("train-", "train"), ("", "code"))


@dataclass(frozen=True)
class Catalog:
    """Sources by name (of a difficulty, say) below a folder, and their versions,
    each a folder of its own."""

    root: str
    names: dict[str, str]

    def path(self, name: str, version: str | None = None) -> str:
        """Where a source lies; a pinned version beside its newest state."""
        if name not in self.names:
            raise KeyError(f"{name}: not one of {sorted(self.names)}")
        base = f"{self.root.rstrip('/')}/{self.names[name]}"
        return f"{base}@{version}" if version else base

    def read(self, spark: SparkSession, name: str, version: str | None = None) -> DataFrame:
        return spark.read.parquet(self.path(name, version))


#: Bytes that one file of a bundle may have, and the bundle.
FILE_LIMIT, BUNDLE_LIMIT = 15 << 20, 30 << 20


def check_bundle(files: DataFrame) -> None:
    """Raises unless a bundle (path, text) keeps to the limits: no file is empty."""
    size = F.octet_length("text")
    r = files.agg(F.count_if(F.coalesce(size, F.lit(0)) == 0).alias("empty"), F.max(size).alias("most"), F.sum(size).alias("total")).first()
    if r["empty"] or (r["most"] or 0) > FILE_LIMIT or (r["total"] or 0) > BUNDLE_LIMIT:
        raise ValueError(f"{r['empty']} empty files, largest {r['most']} bytes, {r['total']} together")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(name: str, routes: Iterable[tuple[str, str]] = ROUTES) -> str:
    """The split of a source: a pattern that ends in '-' is a prefix, another one
    may stand anywhere."""
    for pattern, split in routes:
        if name.startswith(pattern) if pattern.endswith("-") else pattern in name:
            return split
    raise KeyError(name)


def union_with_offsets(
    sources: Iterable[tuple[DataFrame, int]],
    low: int | None = None,
    high: int | None = None,
    reward: str = "final_reward",
) -> DataFrame:
    """All sources in order, problem ids moved by each source's offset.

    Bounds hold for moved ids (low included, high not); each source is filtered
    by its own bound less the offset, so that the filter reaches its files. The
    position of a source stays in ``source_position``, as the order of samples
    goes by it. *reward* names the column that becomes ``final_reward``."""
    out = None
    for position, (df, offset) in enumerate(sources):
        df = normalised(df)
        if low is not None:
            df = df.where(F.col("problem_id") >= low - offset)
        if high is not None:
            df = df.where(F.col("problem_id") < high - offset)
        if reward != "final_reward":
            df = df.withColumn("final_reward", F.col(reward))
        df = df.withColumns({"problem_id": F.col("problem_id") + offset, "source_position": F.lit(position)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def readable(spark: SparkSession, paths: Iterable[str]) -> tuple[list[DataFrame], list[str]]:
    """(frames of the sources that can be read, warnings about the others)."""
    frames, warnings = [], []
    for p in paths:
        try:
            frames.append(spark.read.parquet(p))
        except AnalysisException as e:
            warnings.append(f"{p}: {e.getCondition() or 'unreadable'}")
    return frames, warnings


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a tab-separated file with # comments; lines that don't
    have exactly two fields are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t", -1)
    return lines.where(F.size(parts) == 2).select(parts[0].alias("key"), parts[1].alias("value"))


def write_key_values(df: DataFrame, path: str) -> None:
    """One tab-separated file in key order (a small table by its nature)."""
    df.orderBy("key").coalesce(1).select(F.concat_ws("\t", "key", "value")).write.mode("overwrite").text(path)


def device_rows(spark: SparkSession, path: str) -> DataFrame:
    """(index, utilisation, memory) of a device tool's CSV; '[N/A]' is 0."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    number = lambda i: F.when(parts[i] == "[N/A]", 0.0).otherwise(parts[i].try_cast("double"))
    rows = spark.read.text(path).where(F.size(parts) >= 3)
    return rows.select(parts[0].try_cast("int").alias("index"), number(1).alias("utilisation"), number(2).alias("memory")).where("index is not null")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def save(df: DataFrame, path: str, by: str | None = None, rows_per_file: int = 0) -> None:
    """Writes a table, one folder for each value of *by* (a step or turn)."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(by) if by else writer).parquet(path)


#: Bytes of a file, by what its rows are measured at.
FILE_BYTES = 200_000_000
#: Bytes of the files that one task writes, where there are more tasks than usual.
TASK_BYTES = 256_000_000


def row_bytes(df: DataFrame) -> Column:
    """What a row's values take in a file, or more: texts and bytes as they are, with
    their length, eight or sixteen bytes for numbers, twice the JSON text of nested
    values."""
    sizes = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            sizes.append(F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long")) + 8)
        elif kind in ("array", "map", "struct"):
            sizes.append(F.coalesce(2 * F.octet_length(F.to_json(F.struct(c.alias("v")))).cast("long"), F.lit(0).cast("long")) + 16)
        else:
            sizes.append(F.lit(16 if kind == "decimal" else 8).cast("long"))
    return sum(sizes[1:], sizes[0]) if sizes else F.lit(1).cast("long")


def _files_of(df: DataFrame, path: str) -> None:
    """Writes rows, in order of their numbers __file within a task, to a file for each
    number: to folders at first, from which the files are then moved to *path*."""
    spark = df.sparkSession
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)
    df.write.partitionBy("__file").parquet(f"{path}/_files")
    make = spark._jvm.org.apache.hadoop.fs.Path

    def move(status) -> None:
        file = status.getPath()
        number, name = int(file.getParent().getName().rpartition("=")[2]), file.getName().split("-", 2)[2]
        if not fs.rename(file, make(target, f"part-{number:05d}-{name}")):
            raise OSError(f"{file} can't be moved to {path}")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(move, fs.globStatus(make(f"{path}/_files/__file=*/part-*"))))
    fs.delete(make(f"{path}/_files"), True)
    fs.create(make(target, "_SUCCESS"), True).close()


def save_by_bytes(df: DataFrame, path: str, limit: int = FILE_BYTES, order: list[str] | None = None) -> int:
    """Writes a table to files of at most *limit* bytes, by the measure of their rows
    (a row of over half of it has a file of its own); gives how many. Rows keep the
    order of *order*, if stated, from file to file.

    The rows are written once, each with its size. Within each part of that copy,
    files are cut where the sizes pass the next stretch, a limit less the largest
    row that isn't alone, and the parts' numbers of files, a row for each part,
    number them all. Files are then dealt out in their order, many to a task."""
    spark = df.sparkSession
    room = max(limit - 64_000 - limit // 50, 1)  # a file has headers and a footer
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df
    copy, copied = written(placed.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), row_bytes(df).alias("size"), F.monotonically_increasing_id().alias("at")), "rows")
    alone = F.col("size") > room // 2
    stretch = max(room - (copy.where(~alone).agg(F.max("size")).first()[0] or 0), 1)
    before = lambda *keys: Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a row that is alone parts those before it from those after it
    run = 2 * F.coalesce(F.sum(alone.cast("long")).over(before("part")), F.lit(0)) + alone.cast("long")
    runs = copy.withColumn("part", F.shiftright("at", 33)).withColumn("run", run)
    pieces = runs.withColumn("cut", F.floor(F.coalesce(F.sum("size").over(before("part", "run")), F.lit(0)) / stretch))
    ranked, kept = written(pieces.withColumn("piece", F.dense_rank().over(Window.partitionBy("part").orderBy("run", "cut")) - 1).select("row", "at", "part", "piece"), "pieces")
    counts = ranked.groupBy("part").agg((F.max("piece") + 1).alias("n"))
    first = counts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    files = counts.agg(F.sum("n")).first()[0] or 0
    if files:
        placed = ranked.join(F.broadcast(first), F.col("part") == F.col("of")).withColumn("file", (F.col("first") + F.col("piece")).cast("int"))  # a row for each part
        tasks = min(files, max(n, spark.sparkContext.defaultParallelism, files * limit // TASK_BYTES))
        dealt = placed.repartitionById(tasks, F.floor(F.col("file").cast("long") * tasks / files).cast("int")).sortWithinPartitions("file", "at")
        _files_of(dealt.select("row.*", F.col("file").alias("__file")), path)
    else:
        df.limit(0).write.mode("overwrite").parquet(path)
    forget(copied)
    forget(kept)
    return files


def save_metadata(spark: SparkSession, path: str, **values) -> None:
    """One row of JSON beside a table."""
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(values, default=str, sort_keys=True)).alias("value")).write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
