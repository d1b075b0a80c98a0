"""Conversations: last answers, turn slices, early termination, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded
from tessera.functions.text import strip


def last_assistant(messages="messages") -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.try_element_at(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(-1))["content"]


def response_of(df: DataFrame) -> Column:
    """The last assistant message, else the first fallback column with a value."""
    fallbacks = [F.col(c) for c in ("response", "completion", "output") if c in df.columns]
    return F.coalesce(last_assistant(), *fallbacks)


def first_turns(messages, n: int | Column) -> Column:
    """System and user message, and n pairs of assistant and observation."""
    m = F.col(messages) if isinstance(messages, str) else messages
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(m, F.lit(1), 2 * n + 2)


def early_termination(df: DataFrame, turns: list[int], new: str | None = None, digits: int = 8) -> DataFrame:
    """What stopping after each turn gives: a row that had ended by a turn
    (num_turns up to it; null never ends) keeps its reward; another needs inference
    and has its reward in column *new* (0 without one).

    df has num_turns and final_reward. Success is any reward."""
    if any(t < 1 for t in turns):
        raise ValueError("turns are counted from 1")
    each = df.withColumn("requested_turn", F.explode(F.array(*[F.lit(t) for t in sorted(set(turns))])))
    done = F.coalesce(F.col("num_turns").cast("double"), F.lit(float("inf"))) <= F.col("requested_turn")
    late = F.coalesce(F.col(new), F.lit(0.0)) if new else F.lit(0.0)
    each = each.withColumn("__done", done).withColumn("__new", F.when(done, F.col("final_reward")).otherwise(late))
    ok = F.col("__new") > 0
    return each.groupBy("requested_turn").agg(
        F.count("*").alias("total_trajectories"),
        F.countDistinct("problem_id").alias("unique_problems"),
        F.count_if("__done").alias("already_complete"),
        F.count_if(~F.col("__done")).alias("needed_inference"),
        rounded(F.avg("final_reward"), digits).alias("mean_reward_original"),
        rounded(F.avg("__new"), digits).alias("mean_reward_new"),
        F.count_if(F.col("final_reward") > 0).alias("successes_original"),
        F.count_if(ok).alias("successes_new"),
        F.count_if(F.col("__done") & ok).alias("successes_already_complete"),
        F.count_if(~F.col("__done") & ok).alias("successes_terminated"),
    )


def without_overtaken_analysis(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", channel: str = "channel") -> DataFrame:
    """Drops analysis messages whose next assistant message is a final one."""
    after = Window.partitionBy(conv).orderBy(turn).rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("role") == "assistant", F.coalesce(F.col(channel), F.lit(""))), ignorenulls=True).over(after)
    gone = (F.col("role") == "assistant") & (F.col(channel) == "analysis") & (nxt == "final")
    return turns.withColumn("__gone", F.coalesce(gone, F.lit(False))).where(~F.col("__gone")).drop("__gone")


RULE, THIN = "=" * 80, "\u2500" * 80


def rendered(question, messages, interactions, reward, num_turns, terminated, truncated, cut: int = 50) -> Column:
    """A trajectory as text: a header, each message under its role, and the numbered
    interactions if there are any."""
    q, m, act, r, n, end, short = (F.col(x) if isinstance(x, str) else x for x in (question, messages, interactions, reward, num_turns, terminated, truncated))
    asked = F.when(F.length(q) > cut, F.concat(F.substring(q, F.lit(1), F.lit(cut)), F.lit("..."))).otherwise(q)
    said = lambda flag: F.when(flag, "True").otherwise("False")
    head = F.concat(F.lit(f"{RULE}\nQuestion: "), asked, F.lit("\nReward: "), F.format_string("%.2f", r), F.lit(" | Turns: "), n.cast("string"), F.lit(" | Terminated: "), said(end), F.lit(" | Truncated: "), said(short), F.lit(f"\n{RULE}"))
    body = F.transform(m, lambda x: F.concat(F.lit("\n["), F.upper(x["role"]), F.lit("]\n"), x["content"]))
    runs = F.transform(act, lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] Code:\n"), x["code"], F.lit("\n  Output:\n"), x["output"]))
    count = F.concat(F.lit(f"\n{THIN}\nCode Interactions ("), F.size(act).cast("string"), F.lit("):"))
    lines = F.concat(F.array(head), body, F.when(F.coalesce(F.size(act), F.lit(0)) > 0, F.concat(F.array(count), runs)).otherwise(F.array().cast("array<string>")))
    return F.array_join(lines, "\n")


def inferred_finish(reason, tokens, limit: int) -> Column:
    """'length' where no reason is given and the tokens reach the limit."""
    reason, tokens = (F.col(x) if isinstance(x, str) else x for x in (reason, tokens))
    return F.when(reason.isNull() & (tokens >= limit), "length").otherwise(reason)


# Finish reasons that mean the token limit.
LIMIT_REASONS = ("length", "length_capped", "max_tokens")


def truncation_flags(reasons) -> Column:
    """Of each turn, whether the token limit cut it short."""
    r = F.col(reasons) if isinstance(reasons, str) else reasons
    return F.transform(r, lambda x: F.lower(F.coalesce(x, F.lit(""))).isin(*LIMIT_REASONS))


def truncation_counts(reasons) -> tuple[Column, Column]:
    """(cut short, not) among the finish reasons of a row's turns."""
    flags = truncation_flags(reasons)
    cut = F.size(F.filter(flags, lambda x: x))
    return cut, F.size(flags) - cut


# The words of the prompts that aggregate candidates.
REFINE_HEAD = """You are given a coding problem and a candidate solution.
The candidate may be incomplete or contain errors.
Refine this trajectory and produce an improved, higher-quality solution.
If it is entirely wrong, attempt a new strategy.
Provide your final solution wrapped in ```python``` code blocks.

Problem:
"""
REFINE_MIDDLE = """

Candidate solution (may contain mistakes):
---- Candidate ----
"""
REFINE_TAIL = """

Now refine the candidate into an improved solution. Provide clear reasoning and end with your final code in ```python``` blocks."""
COMBINE_HEAD = """You are given a coding problem and several candidate solutions.
Some candidates may be incorrect or contain errors.
Aggregate the useful ideas and produce a single, high-quality solution.
Reason carefully; if candidates disagree, choose the correct path.
If all are incorrect, then attempt a different strategy.
Provide your final solution wrapped in ```python``` code blocks.

Problem:
"""
COMBINE_MIDDLE = """

Candidate solutions (may contain mistakes):
"""
COMBINE_TAIL = """

Now write a single improved solution. Provide clear reasoning and end with your final code in ```python``` blocks."""


def aggregation_prompt(question, candidates) -> Column:
    """A prompt to improve one candidate, or to combine several numbered ones."""
    q, c = (F.col(x) if isinstance(x, str) else x for x in (question, candidates))
    one = F.concat(F.lit(REFINE_HEAD), strip(q), F.lit(REFINE_MIDDLE), strip(F.get(c, F.lit(0))), F.lit(REFINE_TAIL))
    listed = F.transform(c, lambda x, i: F.concat(F.lit("---- Solution "), (i + 1).cast("string"), F.lit(" ----\n"), strip(x)))
    many = F.concat(F.lit(COMBINE_HEAD), strip(q), F.lit(COMBINE_MIDDLE), F.array_join(listed, "\n"), F.lit(COMBINE_TAIL))
    return F.when(F.size(c) == 1, one).otherwise(many)


def lineage(candidates: DataFrame, parents: str = "aggregated_from", value: str = "response") -> DataFrame:
    """Each candidate with its parents' values, in order: parents are indices
    into the previous step of its problem."""
    edges = candidates.select("problem_id", "rsa_step", "candidate_id", F.posexplode(parents).alias("pos", "parent"))
    old = candidates.select(F.col("problem_id"), (F.col("rsa_step") + 1).alias("rsa_step"), F.col("candidate_id").alias("parent"), F.col(value).alias("v"))
    found = edges.join(old, ["problem_id", "rsa_step", "parent"])
    return found.groupBy("problem_id", "rsa_step", "candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("parents"))
