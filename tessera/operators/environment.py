"""A coding environment as columns: what an action does to a rollout's state.

A state has question, current_turn, max_turns, has_interacted and fn_name.  A step
takes a text as action: code between interact tags is run, a fenced answer is
scored once the rollout has interacted, and anything else is told what to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import framed_output, interact_last_open, timed_out
from tessera.operators.harness import SCORE, with_outputs, with_scores
from tessera.operators.scores import classified

# What the environment says.
REMINDER = (
    "NOTE: You must interact at least once before submitting your final answer. Use <interact> ... your code here ... </interact> to test your code first. "
    "Remember to pass in the inputs yourself. \n\nDo NOT use ```python``` blocks for interaction! You must use <interact> blocks!"
)
MUST_INTERACT = (
    "<output>You must interact at least once before submitting your final answer. Use <interact> ... your code here ... </interact> to test your code first. "
    "Remember to pass in the inputs yourself. Do NOT use ```python``` blocks for interaction!</output>"
)
INVALID_LATER = "<output>No valid code block found. Use <interact></interact> to run your code, or use ```python``` to submit your final answer.</output>"
INVALID_FIRST = (
    "<output>No valid code block found. Use <interact></interact> to run your code. Remember to pass in the inputs yourself. \n\n"
    "Do NOT use ```python``` blocks for interaction! You must use <interact> blocks!</output>"
)


def first_observation(question: Column, system: str = "", interactive: bool = True) -> Column:
    """What a rollout sees first: the system prompt, if any, the question, and in
    interactive mode the reminder."""
    seen = F.concat(F.lit(f"{system}\n\n"), question) if system else question
    return F.concat(seen, F.lit(f"\n\n{REMINDER}")) if interactive else seen


def acted(df: DataFrame, action: str = "action") -> DataFrame:
    """Adds kind and what follows from it alone: current_turn one on, interact_code,
    code, verdict (the evaluator's), observation, terminated and truncated.

    kind is interact, final, must_interact (an answer too early), no_interaction
    (the same at the last turn) or invalid. Observations of interact are left to the
    run, and to final there is none. A state that isn't over at its last turn is
    truncated there."""
    rows = classified(df, action).withColumns({"interact_code": F.nullif(interact_last_open(action), F.lit("")), "current_turn": F.col("current_turn") + 1})
    last = F.col("current_turn") >= F.col("max_turns")
    early = ~F.col("has_interacted")
    kind = F.when(F.col("interact_code").isNotNull(), "interact").when(F.coalesce(F.col("code"), F.lit("")) == "", "invalid").when(early & last, "no_interaction").when(early, "must_interact").otherwise("final")
    rows = rows.withColumn("kind", kind)
    told = F.when(F.col("kind") == "must_interact", MUST_INTERACT).when(F.col("kind") == "invalid", F.when(early, INVALID_FIRST).otherwise(INVALID_LATER)).when(F.col("kind") == "no_interaction", "")
    final = F.col("kind") == "final"
    return rows.withColumns({"observation": told, "terminated": final, "truncated": F.when(final, F.col("verdict") != "execute").otherwise(last)})


def step(rows: DataFrame, seconds: float | None = 1.0, interact_seconds: float | None = None, max_tests: int = 15) -> DataFrame:
    """Runs what acted() has found: observation and has_interacted of interactions,
    final_reward and eval_timeout_count of answers, interaction_timed_out. Rows of
    other kinds never reach a program. *rows* are read more than once, and have to be
    the same each time."""
    kinds = lambda *k: rows.where(F.col("kind").isin(*k))
    none = {"final_reward": F.lit(0.0), "eval_timeout_count": F.lit(0).cast("long"), "interaction_timed_out": F.lit(False)}
    ran = with_outputs(kinds("interact"), seconds=interact_seconds or seconds)
    ran = ran.withColumns({**none, "observation": framed_output("stdout", "stderr", "ok"), "interaction_timed_out": timed_out("stderr"), "has_interacted": F.lit(True)}).drop("ok", "stdout", "stderr")
    ended = with_scores(kinds("final"), seconds, max_tests).withColumns({"observation": F.lit(""), "eval_timeout_count": F.col("n_timeouts"), "interaction_timed_out": F.lit(False)})
    ended = ended.drop(*(c for c in SCORE if c != "final_reward"))
    told = kinds("must_interact", "no_interaction", "invalid").withColumns(none)
    return ran.unionByName(ended).unionByName(told)
