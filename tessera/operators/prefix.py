"""Metrics of the first k samples of each problem, in one pass.

A row whose ordinal is k exists only for problems with at least k samples, so
running aggregates up to each row, averaged by ordinal, give every k at once.
Samples go by (source position, trajectory id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded

#: Success in three senses: full reward, any reward, and the flag or any reward.
FULL = "final_reward = 1.0"
PARTIAL = "final_reward > 0"
FLAGGED = "is_successful or final_reward > 0"


def ordinals(df: DataFrame, problem: str = "problem_id", order: tuple[str, ...] = ("trajectory_id",)) -> DataFrame:
    """Adds k, the position of a sample in its problem, from 1."""
    if "source_position" in df.columns:
        order = ("source_position", *order)
    return df.withColumn("k", F.row_number().over(Window.partitionBy(problem).orderBy(*order)))


def running(df: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Adds best, any_full, mean and success over the first k samples."""
    so_far = Window.partitionBy(problem).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.when(F.col("final_reward") == 1.0, 1.0).otherwise(0.0)
    return df.withColumns(
        {
            "best": F.max("final_reward").over(so_far),
            "any_full": F.max(full).over(so_far),
            "mean": F.avg("final_reward").over(so_far),
            "success": F.avg(full).over(so_far),
        }
    )


def prefix_curve(df: DataFrame, problem: str = "problem_id", digits: int = 8) -> DataFrame:
    """k, n_problems, best_at_k, pass_at_k, mean_at_k, success_at_k over the
    problems that have k samples."""
    r = lambda c: rounded(F.avg(c), digits)
    return (
        running(ordinals(df, problem).select(problem, "k", "final_reward"), problem)
        .groupBy("k")
        .agg(F.count("*").alias("n_problems"), r("best").alias("best_at_k"), r("any_full").alias("pass_at_k"), r("mean").alias("mean_at_k"), r("success").alias("success_at_k"))
    )


def shortest(df: DataFrame, problem: str = "problem_id") -> DataFrame:
    """(least, most, n_problems): samples of the problems."""
    return df.groupBy(problem).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("n_problems"))


def pass_at(df: DataFrame, ks: list[int], success: str = PARTIAL, problem: str = "problem_id", digits: int = 8) -> DataFrame:
    """(k, pass_at_k) over all problems: one with fewer than k samples counts with
    those it has. Empty input has no rows."""
    first = ordinals(df, problem).where(F.expr(f"coalesce({success}, false)")).groupBy(problem).agg(F.min("k").alias("first"))
    per = df.select(problem).distinct().join(first, problem, "left")
    n = per.agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= k).alias(f"k{k}") for k in ks]).where("n > 0")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), rounded(F.col(f"k{k}") / F.col("n"), digits).alias("pass_at_k")) for k in ks]))
    return n.select(rows.alias("r")).select("r.*")


def ladder(num_samples: int, top: int = 256) -> list[int]:
    """1, 2, 4 as they are; from 8 on clamped to the number of samples."""
    out, k = [], 1
    while k <= top:
        out.append(k if k < 8 else min(k, num_samples))
        k *= 2
    return sorted(set(out))


def at_step(df: DataFrame, step: str = "rsa_step", problem: str = "problem_id", digits: int = 8) -> DataFrame:
    """Best, pass, mean and success of each step, a problem counting once; the
    denominator is the candidates that the problem has at the step."""
    full = F.when(F.col("final_reward") == 1.0, 1.0).otherwise(0.0)
    per = df.groupBy(problem, step).agg(F.max("final_reward").alias("best"), F.max(full).alias("any_full"), F.avg("final_reward").alias("mean"), F.avg(full).alias("success"))
    r = lambda c: rounded(F.avg(c), digits)
    return per.groupBy(step).agg(F.count("*").alias("n_problems"), r("best").alias("best_at_step"), r("any_full").alias("pass_at_step"), r("mean").alias("mean_at_step"), r("success").alias("success_at_step"))


def step_summary(df: DataFrame, step: str = "rsa_step", problem: str = "problem_id", digits: int = 8) -> DataFrame:
    """Mean accuracy, pass@1 (first candidate), pass@N, successes and solved
    problems of each step."""
    k = F.row_number().over(Window.partitionBy(problem, step).orderBy("trajectory_id"))
    ok = F.col("final_reward") > 0
    per = df.withColumn("__k", k).groupBy(problem, step).agg(F.sum("final_reward").alias("s"), F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.bool_or(ok & (F.col("__k") == 1)).alias("first"))
    return per.groupBy(step).agg(
        rounded(F.sum("s") / F.sum("n"), digits).alias("mean_accuracy"),
        rounded(F.count_if("first") / F.count("*"), digits).alias("pass_at_1"),
        rounded(F.count_if(F.col("ok") > 0) / F.count("*"), digits).alias("pass_at_n"),
        F.sum("ok").alias("successes"),
        F.count_if(F.col("ok") > 0).alias("solved"),
    )


def forward_passes(curve: DataFrame, factor: int = 10) -> DataFrame:
    """The curve over model calls, of which a sample takes *factor*."""
    return curve.withColumn("forward_passes", F.col("k") * factor)


def guarded(numerator: Column, denominator: Column) -> Column:
    """A ratio that is 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def run_summary(df: DataFrame, success: str = PARTIAL, problem: str = "problem_id", digits: int = 8) -> DataFrame:
    """Rows, problems, successes, solved problems and success rate, in one row."""
    ok = F.expr(success)
    per = df.groupBy(problem).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_problems"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_success"), F.count_if(F.col("ok") > 0).alias("n_solved"))
    return out.withColumn("success_rate", rounded(guarded(F.col("n_success"), F.col("n_rows")), digits))


def completion(df: DataFrame, num_samples: int, problem: str = "problem_id") -> DataFrame:
    """Problems and whether all their samples are there."""
    return df.groupBy(problem).agg(F.count("*").alias("n_done")).withColumn("complete", F.col("n_done") >= num_samples)


def mean_tokens(df: DataFrame, by: list[str], tokens: str = "total_tokens", digits: int = 8) -> DataFrame:
    return df.groupBy(*by).agg(rounded(F.avg(tokens), digits).alias("mean_tokens"))
