"""Streams of events: windows, deduplication, running prefix metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.storage import shared_path


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream with a zoned time, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # the source reads folders; a glob picks the table among its neighbours
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and their value by window and type; later than *late* is dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def running_best(events: DataFrame) -> DataFrame:
    """Samples so far and best value of each user: state that grows with users, not
    events."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))


def drained(df: DataFrame, name: str, mode: str = "complete", key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives the result as a table.

    Batches are written to the shared folder, each replacing what an earlier
    attempt of it wrote. With mode complete the last batch is the table, with append
    all of them are. With update a batch holds the rows that changed, and the table
    has the newest row of each *key*."""
    if mode == "update" and not key:
        raise ValueError("mode update needs a key")
    spark = df.sparkSession
    root = shared_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={0 if mode == 'complete' else number}")

    query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "update":
        rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/rows")
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*df.columns), "batch").alias("row"))
        return newest.select("row.*")
    return spark.read.schema(df.schema).parquet(f"{root}/rows").select(*df.columns)
