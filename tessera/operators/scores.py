"""Rescoring, parity, breakdowns, latencies, viewer and loss columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded
from tessera.functions.text import interact_last_pair, last_fence
from tessera.operators.datasets import numbered
from tessera.operators.prefix import guarded, pass_at


def classified(df: DataFrame, response: str = "response", fn_name: str = "fn_name", require_class: bool = True) -> DataFrame:
    """Adds code and verdict: interact, no_code, no_class (each scored 0 at once)
    or execute. An empty interact block counts as none."""
    block, code = interact_last_pair(response), last_fence(response)
    fn = F.coalesce(F.col(fn_name), F.lit("")) != ""
    verdict = F.when(F.coalesce(block, F.lit("")) != "", "interact").when(code == "", "no_code").when(F.lit(require_class) & fn & ~code.contains("class Solution"), "no_class").otherwise("execute")
    out = df.withColumns({"interact_code": block, "code": code, "verdict": verdict})
    return out.withColumns({"terminated": F.lit(True), "truncated": F.col("verdict") != "execute", "invalidated": F.col("verdict") == "no_class"})


def rescored(df: DataFrame, new: str = "rescored_reward") -> DataFrame:
    """The new reward in place of the old, which stays, and what changed."""
    return df.withColumns({"old_final_reward": F.col("final_reward"), "final_reward": F.col(new), "reward_diff": F.col(new) - F.col("final_reward"), "rescored_is_successful": F.col(new) > 0})


def rescore_metrics(df: DataFrame, digits: int = 8) -> DataFrame:
    """One row: counts, both success rates, pass@1, 2, 4, 8 and the share of
    rewards within 0.01. pass@k is null beyond the samples of the smallest
    problem id."""
    old, new = F.col("old_final_reward") > 0, F.col("final_reward") > 0
    base = df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("problem_id").alias("n_problems"),
        rounded(guarded(F.count_if(old), F.count("*")), digits).alias("original_success_rate"),
        rounded(guarded(F.count_if(new), F.count("*")), digits).alias("new_success_rate"),
        rounded(guarded(F.count_if(F.abs(F.col("final_reward") - F.col("old_final_reward")) < 0.01), F.count("*")), digits).alias("reward_match_rate"),
    )
    lowest = df.groupBy("problem_id").agg(F.count("*").alias("n")).agg(F.min_by("n", "problem_id").alias("samples_per_problem"))
    curve = pass_at(df, [1, 2, 4, 8], digits=digits).groupBy().pivot("k", [1, 2, 4, 8]).agg(F.first("pass_at_k"))
    one = base.crossJoin(lowest).crossJoin(curve)  # one row each
    gate = lambda k: F.when(F.lit(k == 1) | (F.col("samples_per_problem") >= k), F.col(f"`{k}`")).alias(f"pass_at_{k}")
    return one.select("n_rows", "n_problems", "original_success_rate", "new_success_rate", "reward_match_rate", "samples_per_problem", *[gate(k) for k in (1, 2, 4, 8)])


def discrepancies(df: DataFrame, kind: str, tolerance: float = 0.001, digits: int = 8) -> DataFrame:
    """By kind, and over all (null kind): rows, improved, degraded, match rate."""
    diff = F.col("final_reward") - F.col("old_final_reward")
    out = df.rollup(kind).agg(F.count("*").alias("n_rows"), F.count_if(diff > tolerance).alias("improved"), F.count_if(diff < -tolerance).alias("degraded"))
    return out.withColumn("match_rate", rounded(1 - guarded(F.col("improved") + F.col("degraded"), F.col("n_rows")), digits))


def parity(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 0.001) -> DataFrame:
    """Rows of two runs by key: both rewards, their difference and whether it is an
    improvement or a degradation beyond the tolerance. Rows without an old reward
    aren't compared."""
    known = old.where(F.col("final_reward").isNotNull()).select(*keys, F.col("final_reward").alias("original_reward"))
    both = known.join(new.select(*keys, F.col("final_reward").alias("new_reward")), keys).withColumn("diff", F.col("new_reward") - F.col("original_reward"))
    return both.withColumn("change", F.when(F.col("diff") > tolerance, "improved").when(F.col("diff") < -tolerance, "degraded").otherwise("same"))


def breakdown(df: DataFrame, kind: str, digits: int = 8) -> DataFrame:
    """By kind, and over all (null kind): rows with any pass, full reward, cut short
    or invalidated, and the mean reward."""
    return df.rollup(kind).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("final_reward") > 0).alias("any_pass"),
        F.count_if(F.col("final_reward") == 1.0).alias("perfect"),
        F.count_if("truncated").alias("n_truncated"),
        F.count_if("invalidated").alias("n_invalidated"),
        rounded(F.avg("final_reward"), digits).alias("mean_reward"),
    )


def by_problem_type(df: DataFrame, fn_name: str = "fn_name") -> DataFrame:
    """The breakdown by function-call and standard-input problems."""
    kind = F.when(F.coalesce(F.col(fn_name), F.lit("")) != "", "function").otherwise("stdin")
    return breakdown(df.withColumn("problem_type", kind), "problem_type")


def interaction_rollup(runs: DataFrame, digits: int = 6) -> DataFrame:
    """Of each trajectory's runs (problem_id, trajectory_id, ok, duration_ms): how
    many, how many went well and not, and their time together."""
    return runs.groupBy("problem_id", "trajectory_id").agg(
        F.count("*").alias("num_interactions"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), rounded(F.sum("duration_ms"), digits).alias("total_duration_ms")
    )


def latency(df: DataFrame, value: str, by: list[str], slow: float = 4900.0, failed: Column | None = None, digits: int = 6) -> DataFrame:
    """Statistics of each group. Percentiles are the value at index n*p//100 of
    the sorted values, and 0 below 10 (p10, p90) or 100 (p99) of them; the
    deviation is the sample's, 0 for one. A timeout is a failure of *slow* or
    more. Rows without a value don't count."""
    v = F.col(value)
    # positions in one order over all groups: a group of most rows is dealt out too
    placed = numbered(df.where(v.isNotNull()), [*by, value], "__pos")
    groups = placed.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    same = None
    for c in by:
        groups = groups.withColumnRenamed(c, f"__by_{c}")
        one = F.col(c).eqNullSafe(F.col(f"__by_{c}"))
        same = one if same is None else same & one
    ranked = placed.join(groups, same).withColumn("__i", F.col("__pos") - F.col("__first"))
    at = lambda i, least=1: F.max(F.when((F.col("__n") >= least) & (F.col("__i") == F.floor(i)), v))
    of = lambda p, least: F.coalesce(at(F.col("__n") * p / 100, least), F.lit(0.0))
    bad = failed if failed is not None else F.lit(True)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        rounded(F.avg(v), digits).alias("mean"),
        rounded((at((F.col("__n") - 1) / 2) + at(F.col("__n") / 2)) / 2, digits).alias("median"),
        rounded(F.coalesce(F.stddev_samp(v), F.lit(0.0)), digits).alias("stdev"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        of(10, 10).alias("p10"),
        of(90, 10).alias("p90"),
        of(99, 100).alias("p99"),
        F.count_if(bad & (v >= slow)).alias("timeouts"),
    )


def viewed(df: DataFrame, problem=None, trajectory=None, success: bool | None = None, turns: tuple[int, int] | None = None) -> DataFrame:
    """Rows that pass every filter that is set."""
    if problem is not None:
        df = df.where(F.col("problem_id") == problem)
    if trajectory is not None:
        df = df.where(F.col("trajectory_id") == trajectory)
    if success is not None:
        df = df.where((F.col("final_reward") > 0) == success)
    if turns is not None:
        df = df.where(F.col("num_turns").between(*turns))
    return df


def viewer_stats(df: DataFrame, filtered: DataFrame, digits: int = 8) -> DataFrame:
    """Totals, pass rate in per cent and mean turns of all rows, and how many the
    filters leave."""
    ok = F.count_if(F.col("final_reward") > 0)
    total = df.agg(F.count("*").alias("total"), ok.alias("successes"), rounded(100 * guarded(ok, F.count("*")), digits).alias("pass_rate"), rounded(F.avg("num_turns"), digits).alias("avg_turns"))
    return total.crossJoin(filtered.agg(F.count("*").alias("shown")))  # one row each


def rate_of_known(flag: Column) -> Column:
    """Share of true among non-null flags; null without any."""
    return F.avg(F.when(flag, 1.0).when(~flag, 0.0))


def all_passed(flag: Column) -> Column:
    """Whether every known flag is true, and there is one."""
    return F.coalesce(rate_of_known(flag) == 1.0, F.lit(False))


def weighted(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of metrics by weight; a metric without a weight counts nothing."""
    out = F.lit(0.0)
    for name, value in metrics.items():
        out = out + F.coalesce(value, F.lit(0.0)) * weights.get(name, 0.0)
    return out


# --- losses ------------------------------------------------------------------


def group_advantages(by: list[str], reward: str = "final_reward") -> Column:
    """(reward - mean) / (sample deviation + 1e-8) in each group; null where a lone
    sample has no deviation."""
    w = Window.partitionBy(*by)
    return (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + 1e-8)


def batch_advantages(df: DataFrame, reward: str = "final_reward") -> DataFrame:
    """The batch form without a window over all rows: the moments are one row."""
    moments = df.agg(F.avg(reward).alias("__m"), F.stddev_samp(reward).alias("__s"))
    return df.crossJoin(F.broadcast(moments)).withColumn("advantage", (F.col(reward) - F.col("__m")) / (F.col("__s") + 1e-8)).drop("__m", "__s")


def completion_mask(length: Column, prompt: Column) -> Column:
    """1 from the prompt's end on, else 0."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i >= prompt, 1.0).otherwise(0.0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values that the mask lets through, over one at least."""
    return _total(F.zip_with(values, mask, lambda v, m: v * m)) / F.greatest(_total(mask), F.lit(1.0))


def clipped_loss(new: Column, old: Column, advantage: Column, mask: Column, clip: float = 0.2) -> Column:
    """The clipped policy loss of arrays of token log-probabilities."""
    ratio = F.zip_with(new, old, lambda a, b: F.exp(a - b))
    terms = F.transform(ratio, lambda r: -F.least(r * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), r)) * advantage))
    return masked_mean(terms, mask)


def kl_penalty(new: Column, reference: Column, mask: Column) -> Column:
    return masked_mean(F.zip_with(new, reference, lambda a, b: a - b), mask)


def cross_entropy(log_probs: Column, mask: Column) -> Column:
    """Of the log-probabilities of tokens after the first."""
    tail = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    return -masked_mean(tail(log_probs), tail(mask))


def log_softmax_at(logits: Column, index: Column) -> Column:
    top = F.array_max(logits)
    return F.get(logits, index) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def total_loss(policy: Column, kl: Column, coefficient: float) -> Column:
    return policy + coefficient * kl


def padded(tokens: Column, size: Column, pad: int = 0) -> Column:
    """Tokens up to a common size."""
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(size - F.size(tokens), F.lit(0)).cast("int")))
