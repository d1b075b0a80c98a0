"""Rollouts in rounds: multi-turn, aggregation of candidates, budget forcing.

A generator turns prompts into texts and is pluggable; anything that maps a
(prompt, seed) batch will do.  Every round's states are written to a folder of
their own before and after execution; a manifest names the last phase that is
whole, and a run that is started again goes on from there."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import close_interact, tail_in_frame
from tessera.operators.datasets import draw_number, seeded_rollouts, seeded_subset
from tessera.operators.environment import acted, first_observation, step
from tessera.operators.harness import dealt, with_scores
from tessera.operators.scores import classified
from tessera.operators.turns import aggregation_prompt, last_assistant
from tessera.sources.tables import load_metadata, save_metadata
from tessera.storage import cut

#: prompts and seeds to texts
Generator = Callable[[pd.Series, pd.Series], pd.Series]

#: Settings in which a run may not differ from the one it goes on with.
COMPARED = ("num_problems", "num_samples", "dataset", "model", "max_turns", "population", "k", "attempts", "max_tokens")


class Rounds:
    """Phases of a run, each a table below *root*; what is whole is in a
    manifest that is written after the table. A run that goes on with other
    settings (COMPARED) is warned, or refused if it is strict."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = False, **settings):
        self.spark, self.root, self.strict, self.settings = spark, root.rstrip("/"), strict, settings

    def done(self, phase: str) -> bool:
        try:
            load_metadata(self.spark, f"{self.root}/{phase}.manifest")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
        return True

    def table(self, phase: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The phase's table: as it was written, or made and written now."""
        path = f"{self.root}/{phase}"
        if self.done(phase):
            for changed in self.drift(phase):
                if self.strict:
                    raise ValueError(f"{phase} was written with other settings: {changed}")
                warnings.warn(f"{phase} was written with other settings: {changed}", stacklevel=3)
        else:
            make().write.mode("overwrite").parquet(path)
            save_metadata(self.spark, f"{path}.manifest", phase=phase, **self.settings)
        return self.spark.read.parquet(path)

    def drift(self, phase: str) -> list[str]:
        """Settings that differ from those the phase was written with."""
        old = load_metadata(self.spark, f"{self.root}/{phase}.manifest")
        return [f"{k}: {old.get(k)} then, {self.settings[k]} now" for k in COMPARED if k in self.settings and old.get(k) != self.settings[k]]


def generated(df: DataFrame, prompt: str, seed: str, generate: Generator, out: str = "text") -> DataFrame:
    """Adds the generator's text for each row; only prompts and seeds reach Python."""

    @F.pandas_udf(StringType())
    def texts(prompts: pd.Series, seeds: pd.Series) -> pd.Series:
        return generate(prompts, seeds)

    return df.withColumn(out, texts.asNondeterministic()(prompt, seed))


def multi_turn(spark: SparkSession, problems: DataFrame, root: str, generate: Generator, samples: int, max_turns: int = 5, seconds: float = 1.0, system: str = "", final_prompt: str = "This is the last turn.", tail: int = 0) -> DataFrame:
    """Rolls out every problem *samples* times in the coding environment:
    (problem_id, trajectory_id, n_turns, final_reward, terminated, truncated,
    has_interacted, eval_timeouts, interaction_timeouts, transcript).

    problems has problem_id, question, fn_name and tests. A round lets every active
    state speak and takes one step; at the last turn the prompt says so. With *tail*
    long outputs keep their last tokens. A rollout ends when it is terminated or
    truncated."""
    rounds = Rounds(spark, root, num_samples=samples, max_turns=max_turns)
    keys = ["problem_id", "trajectory_id"]
    zero = F.lit(0).cast("long")
    seeds = seeded_rollouts(dealt(problems, ["problem_id"]), samples).select("problem_id", F.col("sample_index").alias("trajectory_id"), first_observation(F.col("question"), system).alias("transcript"), "fn_name", "tests")
    start = {"current_turn": F.lit(0), "max_turns": F.lit(max_turns), "has_interacted": F.lit(False), "eval_timeouts": zero, "interaction_timeouts": zero}
    states = rounds.table("round=0", lambda: seeds.withColumns(start))
    carried = states.columns
    finished = None
    for turn in range(1, max_turns + 1):
        prompt = F.concat("transcript", F.lit(f"\n\n{final_prompt}")) if turn == max_turns else F.col("transcript")
        asked = states.withColumns({"prompt": prompt, "seed": draw_number(*keys, F.lit(turn))})
        spoken = rounds.table(f"round={turn}-spoken", lambda asked=asked: acted(generated(asked, "prompt", "seed", generate).withColumn("action", close_interact("text")).drop("prompt", "seed", "text")))

        def executed(spoken=spoken):
            done = step(spoken, seconds)
            seen = tail_in_frame("observation", tail) if tail else F.col("observation")
            return done.withColumns(
                {
                    "transcript": F.concat_ws("\n\n", "transcript", "action", F.nullif(seen, F.lit(""))),
                    "eval_timeouts": F.col("eval_timeouts") + F.col("eval_timeout_count"),
                    "interaction_timeouts": F.col("interaction_timeouts") + F.col("interaction_timed_out").cast("long"),
                }
            ).select(*carried, "final_reward", "terminated", "truncated")

        after = rounds.table(f"round={turn}", executed)
        over = after.where("terminated or truncated").select(*keys, F.col("current_turn").alias("n_turns"), "final_reward", "terminated", "truncated", "has_interacted", "eval_timeouts", "interaction_timeouts", "transcript")
        finished = over if finished is None else finished.unionByName(over)
        states = after.where("not (terminated or truncated)").select(*carried)
        if states.isEmpty():
            break
    return finished


def reevaluated(completed: DataFrame, active: DataFrame, keys: list[str], seconds: float = 1.0, max_tests: int = 100, require_class: bool = True) -> DataFrame:
    """A checkpoint's rollouts with rewards: completed ones keep theirs, active ones
    are scored on their last assistant message and count as cut short; those
    without such a message go. from_active tells them apart. Rows are dealt
    out by *keys*, which needn't be unique."""
    row = F.struct(*[F.col(f"`{c}`") for c in active.columns]).alias("row")
    told = dealt(active, keys).select(row, F.col("tests.fn_name").alias("fn_name"), last_assistant().alias("response")).where(F.coalesce(F.col("response"), F.lit("")) != "")
    rows = cut(classified(told, require_class=require_class).select("row", "verdict", "code", "fn_name"), "active").withColumn("tests", F.col("row.tests"))
    late = with_scores(rows, seconds, max_tests).select("row.*", F.col("final_reward").alias("__reward")).drop("final_reward").withColumnRenamed("__reward", "final_reward")
    late = late.withColumns({"terminated": F.lit(False), "truncated": F.lit(True), "from_active": F.lit(True)})
    return completed.withColumn("from_active", F.lit(False)).unionByName(late, allowMissingColumns=True)


def by_harness(problems: DataFrame, seconds: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A scorer of responses: runs each on its problem's tests, its own column or
    from *problems* (problem_id, tests)."""

    def score(df: DataFrame) -> DataFrame:
        rows = df if "tests" in df.columns else df.join(problems.select("problem_id", "tests"), "problem_id")
        # written, as a generator may say something else when it is asked again
        rows = cut(classified(rows.withColumn("fn_name", F.col("tests.fn_name"))), "responses")
        return with_scores(rows, seconds).select(*df.columns, "final_reward")

    return score


def aggregated(spark: SparkSession, problems: DataFrame, root: str, generate: Generator, score: Callable[[DataFrame], DataFrame], population: int = 4, k: int = 2, steps: int = 3, seed: int = 42) -> DataFrame:
    """Candidates of every step: (problem_id, rsa_step, candidate_id, response,
    final_reward, aggregated_from). After the first step each candidate comes
    from k of the step before, drawn by seed, problem, step and candidate. *score* gets
    the problems' tests, too, if they have any, and has to read its rows once."""
    rounds = Rounds(spark, root, population=population, k=k)
    carried = [c for c in ("problem_id", "question", "tests") if c in problems.columns]
    everything = previous = None
    for step in range(1, steps + 1):

        def made(previous=previous, step=step):
            cells = dealt(problems.select(*carried), ["problem_id"])
            if previous is not None:
                pool = F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "response"))), lambda x: x["response"])
                cells = cells.join(dealt(previous.select("problem_id", "candidate_id", "response"), ["problem_id"]).groupBy("problem_id").agg(pool.alias("pool")), "problem_id")
            rows = cells.withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(population - 1))))
            if previous is None:
                rows = rows.withColumns({"aggregated_from": F.array().cast("array<int>"), "prompt": F.col("question")})
            else:
                chosen = seeded_subset(F.sequence(F.lit(0), F.lit(population - 1)), k, F.lit(seed), F.col("problem_id"), F.lit(step), F.col("candidate_id"))
                rows = rows.withColumn("aggregated_from", chosen)
                rows = rows.withColumn("prompt", aggregation_prompt("question", F.transform("aggregated_from", lambda i: F.get(F.col("pool"), i)))).drop("pool")
            told = generated(rows.withColumn("seed", draw_number("problem_id", "candidate_id", F.lit(step))), "prompt", "seed", generate, "response")
            return score(told.drop("seed", "prompt")).withColumn("rsa_step", F.lit(step)).select("problem_id", "rsa_step", "candidate_id", "response", "final_reward", "aggregated_from")

        previous = rounds.table(f"step={step}", made)
        everything = previous if everything is None else everything.unionByName(previous)
    return everything


def budget_forced(spark: SparkSession, problems: DataFrame, root: str, generate: Generator, attempts: int = 5, max_tokens: int = 4096, shared_budget: bool = False) -> DataFrame:
    """(problem_id, response, num_extensions, total_tokens): thoughts are extended
    by " Wait" between attempts. Each attempt has the whole budget, or all share
    it; num_extensions is the index of the last attempt."""
    rounds = Rounds(spark, root, attempts=attempts, max_tokens=max_tokens)
    states = rounds.table("attempt=start", lambda: problems.select("problem_id", F.col("question").alias("prompt"), F.lit("").alias("response"), F.lit(0).alias("num_extensions"), F.lit(0).cast("long").alias("total_tokens")))
    for i in range(attempts):

        def made(states=states, i=i):
            so_far = F.when(F.lit(i > 0), F.concat("response", F.lit(" Wait"))).otherwise(F.col("response"))
            rows = states.withColumns({"response": so_far, "seed": draw_number("problem_id", F.lit(i))}).withColumn("whole", F.concat("prompt", F.lit("\n"), "response"))
            told = generated(rows, "whole", "seed", generate)
            tokens = F.split("text", " ", -1)
            left = F.greatest(F.lit(max_tokens) - F.col("total_tokens"), F.lit(0)) if shared_budget else F.lit(max_tokens)
            kept = F.slice(tokens, F.lit(1), left.cast("int"))
            return told.select("problem_id", "prompt", F.concat("response", F.array_join(kept, " ")).alias("response"), F.lit(i).alias("num_extensions"), (F.col("total_tokens") + F.size(kept)).alias("total_tokens"))

        states = rounds.table(f"attempt={i}", made)
    return states.drop("prompt")
