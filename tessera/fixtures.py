"""Rollout-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table

FENCE = "```"


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each event: a user is a problem, its events in time are samples."""
    e = table(spark, folder, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("problem_id"),
        (F.row_number().over(order) - 1).cast("long").alias("trajectory_id"),
        "event_id",
        F.when(F.col("value") < 20, 0.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100)).alias("final_reward"),
        (1 + F.col("event_id") % 10).alias("num_turns"),
        (F.col("event_type") != "error").alias("terminated"),
        (F.col("event_type") == "error").alias("truncated"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_type").isin("view", "click"), "multi").otherwise("single").alias("mode"),
        F.when(F.col("event_id") % 7 == 0, "length").when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise("stop").alias("finish_reason"),
    ).withColumns(
        {
            "rescored_reward": F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("final_reward")),
            "rsa_step": 1 + F.col("event_id") % 3,
        }
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, messages in turn order)."""
    c = table(spark, folder, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, fn_name, response) with fences and tags around document texts."""
    d, n, f = table(spark, folder, "documents"), F.lit("\n"), F.lit(FENCE)
    kind, text, lit = F.col("doc_id") % 6, F.col("text"), F.lit
    run = F.when(F.col("doc_id") % 12 == 2, F.concat(f, lit("Python"), n, lit("print(1)"), n, f)).otherwise(lit("print(1)"))
    response = (
        F.when(kind == 0, F.concat(f, lit("python"), n, text, n, f))
        .when(kind == 1, F.concat(lit("Plan"), n, f, n, lit("first"), n, f, n, lit("then"), n, f, lit("py"), n, text, n, f))
        .when(kind == 2, F.concat(lit("<interact>"), run, lit("</interact>"), n, f, lit("python"), n, text, n, f))
        .when(kind == 3, F.concat(lit("<interact></interact>"), n, f, lit("python"), n, lit("class Solution: pass"), n, text, n, f))
        .when(kind == 4, text)
        .otherwise(F.concat(f, lit("c++"), n, text, n, f, n, lit("after")))
    )
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "solve").alias("fn_name"), response.alias("response"))
