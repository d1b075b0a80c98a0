"""Folders and tables that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Drops a write's own shuffle files when it ends: nothing reads them again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a local session takes a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/tessera/{uuid.uuid4().hex}/{what}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the cluster's own file layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def forget(path: str) -> None:
    """Deletes what was written to a shared path; nothing may read it any more."""
    spark = _written.pop(path, None)
    if spark is not None:
        fs, p = hadoop_path(spark, path.rpartition("/")[0])
        fs.delete(p, True)


def _clean() -> None:
    for path in list(_written):
        try:
            forget(path)
        except Exception:  # noqa: BLE001  the session has gone; the folder's owner cleans up
            return


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """(the frame as it was written to the shared folder, its path): a lost executor
    costs a re-read, not a recomputation, and plans stay short."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    """The frame as it was written to the shared folder."""
    return written(df, what)[0]
