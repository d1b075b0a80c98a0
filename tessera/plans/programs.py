"""Queries that run programs, loops or streams; SQL has no form for most."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import harness, loops, sandbox, scores
from tessera.plans.registry import query
from tessera.schemas import TESTS
from tessera.sources.tables import table
from tessera.storage import cut, shared_path
from tessera.streaming import events, rollouts


def _workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return shared_path(spark, name)


def problems(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    """Small tasks made of parts, the first *n* or all: add a part's size to a
    number, as a program or as a function."""
    p = table(spark, d, "part")
    if n is not None:
        p = p.orderBy("p_partkey").limit(n)
    size = F.col("p_size")
    inputs = F.array(*[F.lit(str(x)) for x in (1, 5, 12)])
    outputs = F.array(*[(size + x).cast("string") for x in (1, 5, 12)])
    fn = F.when(F.col("p_partkey") % 2 == 0, "solve")
    return p.select(F.col("p_partkey").alias("problem_id"), F.concat(F.lit("Add "), size.cast("string")).alias("question"), fn.alias("fn_name"), F.struct(inputs.alias("inputs"), outputs.alias("outputs"), fn.alias("fn_name")).cast(TESTS).alias("tests"))


def _answer(size: str, seed: int) -> str:
    wrong = 0 if seed % 3 else 1
    body = f"class Solution:\n    def solve(self, x):\n        return x + {size} + {wrong}\nif __name__ == '__main__':\n    print(int(input()) + {size} + {wrong})"
    return f"```python\n{body}\n```"


def _size(prompt: str) -> str:
    return prompt.split("Add ")[1].split()[0]


def scripted(prompts: pd.Series, seeds: pd.Series) -> pd.Series:
    """A generator for tests. At first it interacts, or answers too early, or says
    nothing of use, by the seed; it interacts where it is told to, and else once
    more in a case of five; then it answers, rightly in two cases of three."""

    def one(prompt: str, seed: int) -> str:
        interact, seen = f"<interact>print({_size(prompt)} + 1)", prompt.rpartition("<output>")
        if not seen[1]:
            return [_answer(_size(prompt), seed), interact, interact, "I think."][seed % 4]
        if "You must interact at least once" in seen[2] or "No valid code block found" in seen[2] or seed % 5 == 0:
            return interact
        return _answer(_size(prompt), seed)

    return pd.Series([one(p, s) for p, s in zip(prompts, seeds)], index=prompts.index)


def answering(prompts: pd.Series, seeds: pd.Series) -> pd.Series:
    """Answers at once, rightly in two cases of three."""
    return pd.Series([_answer(_size(p), s) for p, s in zip(prompts, seeds)], index=prompts.index)


def pondering(prompts: pd.Series, seeds: pd.Series) -> pd.Series:
    """One to twenty words of thought."""
    return pd.Series([" ".join([f"t{s % 7}"] * (s % 20 + 1)) for s in seeds], index=prompts.index)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    told = loops.generated(problems(spark, d).withColumns({"prompt": F.concat("question", F.lit(" <output>")), "seed": F.xxhash64("problem_id")}), "prompt", "seed", answering)
    return scores.classified(told, "text")


@query(
    """SELECT p_partkey AS problem_id, CAST(CASE WHEN k = 0 THEN 1 ELSE 0 END AS DOUBLE) AS final_reward, CAST(CASE WHEN k = 0 THEN 3 ELSE 0 END AS BIGINT) AS n_passed, CAST(3 AS BIGINT) AS n_tests, CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_timeouts
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS k FROM part)"""
)
def harness_score(spark, d):
    """Programs that are right, wrong, or never end on the first test (and stop at
    once on others)."""
    p = problems(spark, d)
    size = F.element_at(F.split("question", " "), -1)
    wrong = F.when(F.col("problem_id") % 3 == 0, "1").otherwise("0")
    slow = F.col("problem_id") % 50 == 7
    answer = F.concat(F.lit("x + "), size, F.lit(" + "), wrong)
    body = F.when(F.col("fn_name").isNotNull(), F.concat(F.lit("class Solution:\n    def solve(self, x: List[int]):\n        return "), answer)).otherwise(F.concat(F.lit("x = int(input())\nprint("), answer, F.lit(")")))
    hung = F.when(F.col("fn_name").isNotNull(), F.lit("class Solution:\n    def solve(self, x):\n        while x == 1: pass")).otherwise(F.lit("x = int(input())\nwhile x == 1: pass"))
    rows = p.withColumn("text", F.concat(F.lit("```python\n"), F.when(slow, hung).otherwise(body), F.lit("\n```")))
    return harness.scored(scores.classified(rows, "text"), ["problem_id"], 0.3).drop("late_tests")


def _programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs by part: right, wrong (a third of them), endless on the first test
    (7 of 250), ending their sandbox on the last test, once the others are through
    (11 of 500), or on every test (3 of 500)."""
    p = problems(spark, d)
    key, size = F.col("problem_id"), F.element_at(F.split("question", " "), -1)
    called = F.col("fn_name").isNotNull()
    answer = F.concat(F.lit("x + "), size, F.when(key % 3 == 0, " + 1").otherwise(""))
    first = (
        F.when(key % 250 == 7, "while x == 1: pass")
        .when(key % 500 == 11, "if x == 12: import time; time.sleep(1.2); os.kill(os.getppid(), 9)")
        .when(key % 500 == 3, "os.kill(os.getppid(), 9)")
        .otherwise("pass")
    )
    script = F.concat(F.lit("x = int(input())\n"), first, F.lit("\nprint("), answer, F.lit(")"))
    function = F.concat(F.lit("class Solution:\n    def solve(self, x):\n        "), first, F.lit("\n        return "), answer)
    return p.withColumn("code", F.when(called, function).otherwise(script))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return sandbox.test_runs(_programs(spark, d), ["problem_id"], 2.0)


_RUNS = """SELECT p_partkey AS problem_id, CAST(test AS INTEGER) AS test,
    CASE WHEN p_partkey % 500 = 3 OR p_partkey % 500 = 11 AND test = 2 THEN NULL WHEN p_partkey % 250 = 7 AND test = 0 THEN FALSE ELSE p_partkey % 3 <> 0 END AS verdict,
    p_partkey % 250 = 7 AND test = 0 AS late, CASE WHEN p_partkey % 500 = 3 OR p_partkey % 500 = 11 AND test = 2 THEN 'sandbox' END AS error,
    CAST(CASE WHEN p_partkey % 500 = 3 THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM part, (SELECT unnest(range(3)) AS test)"""


@query(_RUNS)
def test_verdicts(spark, d):
    """A row a test: true, false (wrong or late) or null, where the sandbox went."""
    return _runs(spark, d).drop("milliseconds")


@query(
    f"""WITH r AS ({_RUNS})
    SELECT problem_id, count(*) AS n_tests, count(verdict) AS n_verdicts, count(*) FILTER (verdict) AS n_passed, CASE WHEN count(verdict) > 0 THEN CAST(count(*) FILTER (verdict) AS DOUBLE) / count(verdict) ELSE CAST(0 AS DOUBLE) END AS pass_rate,
    count(verdict) > 0 AND count(verdict) = count(*) FILTER (verdict) AS passed, count(*) FILTER (late) AS n_late, coalesce(list(test ORDER BY test) FILTER (late), CAST([] AS INTEGER[])) AS late_tests, count(verdict) = 0 AS sandbox_error
    FROM r GROUP BY problem_id"""
)
def verdict_means(spark, d):
    return sandbox.verdict_means(_runs(spark, d), ["problem_id"], 2)


@query(
    f"""WITH r AS ({_RUNS})
    SELECT count(DISTINCT problem_id) AS n_programs, count(*) AS n_tests, count(*) FILTER (late) AS n_late, CAST(count(*) FILTER (late) AS DOUBLE) / count(*) AS late_rate, count(DISTINCT problem_id) FILTER (late) AS programs_late FROM r"""
)
def late_report(spark, d):
    """Late tests of all programs, from their runs."""
    return sandbox.late_report(sandbox.verdict_means(_runs(spark, d), ["problem_id"]))


@query(
    f"""WITH r AS ({_RUNS})
    SELECT CASE WHEN p.p_partkey % 2 = 0 THEN 'function' ELSE 'stdin' END AS kind, count(*) AS n, TRUE AS ordered, count(*) FILTER (late) AS timeouts
    FROM r JOIN part p ON r.problem_id = p.p_partkey WHERE error IS NULL GROUP BY ALL"""
)
def run_latency(spark, d):
    """Milliseconds of the tests that were run, by kind: as many as have a verdict,
    their statistics in order, and as many of 1.9 seconds or more as were late."""
    kind = F.when(F.col("problem_id") % 2 == 0, "function").otherwise("stdin").alias("kind")
    times = cut(_runs(spark, d), "runs").where("error is null").select(kind, F.col("milliseconds").cast("double").alias("ms"), "late")
    stats = scores.latency(times, "ms", ["kind"], 1900.0, F.col("late"))
    return stats.select("kind", "n", (F.col("low") <= F.col("median")).alias("ordered") & (F.col("median") <= F.col("high")), "timeouts").toDF("kind", "n", "ordered", "timeouts")


#: The seed of a draw in DuckDB, from its parts.
_SEED = "CAST(concat('0x', substr(md5(concat_ws(',', {})), 1, 15)) AS BIGINT)"
#: Two rollouts of three turns of each part, by their seeds: s1 says whether the first
#: turn interacts, s2 and s3 what follows.
_ROLLOUTS = f"""WITH s AS (SELECT p_partkey AS problem_id, CAST(s AS INTEGER) AS trajectory_id, {_SEED.format("p_partkey, s, 1")} AS s1, {_SEED.format("p_partkey, s, 2")} AS s2, {_SEED.format("p_partkey, s, 3")} AS s3 FROM part, (SELECT unnest(range(2)) AS s)),
    e AS (SELECT *, s1 % 4 IN (1, 2) AND s2 % 5 <> 0 AS second, s3 % 5 <> 0 AS third FROM s),
    r AS (SELECT problem_id, trajectory_id, CAST(CASE WHEN second THEN 2 ELSE 3 END AS INTEGER) AS n_turns, CAST(CASE WHEN second THEN s2 % 3 <> 0 ELSE third AND s3 % 3 <> 0 END AS DOUBLE) AS final_reward,
    second OR third AS terminated, NOT (second OR third) AS truncated, TRUE AS has_interacted, CAST(0 AS BIGINT) AS eval_timeouts, CAST(0 AS BIGINT) AS interaction_timeouts FROM e)"""


@query(f"{_ROLLOUTS} SELECT * FROM r")
def rollout_loop(spark, d):
    """Rollouts with their rewards: answers too early, useless ones, more than one
    interaction, and ends by answer and by turns."""
    return loops.multi_turn(spark, problems(spark, d), _workspace(spark, "rollout"), scripted, 2, 3).drop("transcript")


@query(f"{_ROLLOUTS} SELECT count(*) AS n, count(DISTINCT (problem_id, trajectory_id)) AS n_pairs, TRUE AS turns_fit, TRUE AS scored_ones_interacted, TRUE AS ended_once, sum(final_reward) AS total_reward FROM r")
def rollout_rules(spark, d):
    """Every rollout ends once, within its turns, and none is scored that hasn't
    interacted; the rewards are what the answers earn."""
    r = loops.multi_turn(spark, problems(spark, d), _workspace(spark, "rules"), scripted, 2, 3)
    pair = F.struct("problem_id", "trajectory_id")
    return r.agg(
        F.count("*").alias("n"), F.countDistinct(pair).alias("n_pairs"), F.bool_and(F.col("n_turns").between(1, 3)).alias("turns_fit"),
        F.bool_and(~F.col("terminated") | F.col("has_interacted")).alias("scored_ones_interacted"), F.bool_and(F.col("terminated") | F.col("truncated")).alias("ended_once"),
        F.sum("final_reward").alias("total_reward"),
    )


@query(
    f"""WITH c AS (SELECT p_partkey, CAST(step AS INTEGER) AS step, CAST(c AS INTEGER) AS c, {_SEED.format("p_partkey, c, step")} AS s FROM part, (SELECT unnest(range(1, 4)) AS step), (SELECT unnest(range(4)) AS c)),
    f AS (SELECT p_partkey, step, c, i, row_number() OVER (PARTITION BY p_partkey, step, c ORDER BY md5(concat_ws(',', 42, p_partkey, step, c, i))) AS k FROM c, (SELECT unnest(range(4)) AS i) WHERE step > 1),
    g AS (SELECT p_partkey, step, c, string_agg(i, ' ' ORDER BY k) AS aggregated_from FROM f WHERE k <= 2 GROUP BY ALL)
    SELECT p_partkey AS problem_id, step AS rsa_step, c AS candidate_id, CAST(s % 3 <> 0 AS DOUBLE) AS final_reward, coalesce(aggregated_from, '') AS aggregated_from FROM c LEFT JOIN g USING (p_partkey, step, c)"""
)
def rsa_loop(spark, d):
    """Candidates of three steps, each scored by running it."""
    p = problems(spark, d)
    score = loops.by_harness(p)
    out = loops.aggregated(spark, p, _workspace(spark, "aggregation"), answering, score).drop("response")
    return out.withColumn("aggregated_from", F.array_join("aggregated_from", " "))


@query(
    f"""WITH a AS (SELECT p_partkey, CAST(i AS INTEGER) AS i, {_SEED.format("p_partkey, i")} AS s FROM part, (SELECT unnest(range(3)) AS i)),
    k AS (SELECT p_partkey, i, least(s % 20 + 1, 12) AS n, concat('t', s % 7) AS w FROM a)
    SELECT p_partkey AS problem_id, string_agg(concat(rtrim(repeat(concat(w, ' '), n)), CASE WHEN i < 2 THEN ' Wait' ELSE '' END), '' ORDER BY i) AS response, CAST(2 AS INTEGER) AS num_extensions, CAST(sum(n) AS BIGINT) AS total_tokens FROM k GROUP BY p_partkey"""
)
def budget_loop(spark, d):
    """Three attempts of at most twelve words each."""
    return loops.budget_forced(spark, problems(spark, d), _workspace(spark, "budget"), pondering, 3, 12)


@query(
    f"""WITH a AS (SELECT p_partkey, CAST(i AS INTEGER) AS i, {_SEED.format("p_partkey, i")} AS s FROM part, (SELECT unnest(range(3)) AS i)),
    k AS (SELECT p_partkey, i, s % 20 + 1 AS n, concat('t', s % 7) AS w, coalesce(sum(s % 20 + 1) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
    l AS (SELECT *, CAST(greatest(least(n, 12 - before), 0) AS BIGINT) AS kept FROM k)
    SELECT p_partkey AS problem_id, string_agg(concat(rtrim(repeat(concat(w, ' '), kept)), CASE WHEN i < 2 THEN ' Wait' ELSE '' END), '' ORDER BY i) AS response, CAST(2 AS INTEGER) AS num_extensions, CAST(sum(kept) AS BIGINT) AS total_tokens FROM l GROUP BY p_partkey"""
)
def shared_budget_loop(spark, d):
    """The same, but all attempts share the twelve words."""
    return loops.budget_forced(spark, problems(spark, d), _workspace(spark, "shared"), pondering, 3, 12, shared_budget=True)


@query(f"{_ROLLOUTS} SELECT *, TRUE AS same FROM r")
def resume_equal(spark, d):
    """A run that is started again on its own phases gives the same table."""
    root = _workspace(spark, "resume")
    first, second = (loops.multi_turn(spark, problems(spark, d), root, scripted, 2, 3).drop("transcript") for _ in range(2))
    again = second.select(F.struct("problem_id", "trajectory_id").alias("key"), F.struct(*[c for c in second.columns]).alias("row"))
    key = F.struct("problem_id", "trajectory_id")
    return first.withColumn("row", F.struct(*[F.col(c) for c in first.columns])).join(again.withColumnRenamed("row", "other"), key == F.col("key"), "left").withColumn("same", F.col("row").eqNullSafe(F.col("other"))).drop("row", "key", "other")


@query(
    f"""{_ROLLOUTS}, l AS (SELECT *, problem_id % 50 = 9 AS lost FROM r)
    SELECT r.problem_id, r.trajectory_id, CAST(CASE WHEN lost THEN 1 ELSE n_turns END AS INTEGER) AS n_turns, CASE WHEN lost THEN 0 ELSE final_reward END AS final_reward, terminated AND NOT lost AS terminated, truncated OR lost AS truncated,
    CASE WHEN lost THEN s1 % 4 IN (1, 2) ELSE has_interacted END AS has_interacted, eval_timeouts, interaction_timeouts, NOT lost AS answered FROM l r JOIN s USING (problem_id, trajectory_id)"""
)
def rollout_stream(spark, d):
    """The answers of a batch of rollouts as a stream, which ends them with the same
    rewards; some second answers never come, and their timer ends the rollout."""
    p = problems(spark, d)
    loops.multi_turn(spark, p, root := _workspace(spark, "recorded"), scripted, 2, 3).count()
    keys, hour = ["problem_id", "trajectory_id"], "timestamp '2026-01-01 00:00:00'"
    fields = [*keys, F.col("turn"), F.col("action"), F.col("ts")]
    folder = shared_path(spark, "answers")
    # answers by turn, the later turns first in the first files, and one of the next day
    begun = spark.read.parquet(f"{root}/round=0").withColumns({"turn": F.lit(0), "action": F.lit(None).cast("string"), "ts": F.expr(hour)})
    begun.select(*fields).write.parquet(folder)
    for turn in (2, 1, 3):
        told = spark.read.parquet(f"{root}/round={turn}-spoken").withColumns({"turn": F.lit(turn), "ts": F.expr(f"{hour} + interval 1 minute * {turn}")})
        told.where("not (problem_id % 50 = 9 and turn > 1)").select(*fields).write.mode("append").parquet(folder)
    p.agg(F.min("problem_id").alias("problem_id")).select("problem_id", F.lit(-1).alias("trajectory_id"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("action"), F.expr(f"{hour} + interval 1 day").alias("ts")).write.mode("append").parquet(folder)
    answers = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return events.drained(rollouts.ended_rollouts(answers, p, 3), "ended", "append")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    counts = events.window_counts(events.stream(spark, d), late="3650 days")
    out = events.drained(counts, "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("total") + 1e-9, 6).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    seen = events.first_seen(events.stream(spark, d), ["user_id", "event_type"], "3650 days")
    return events.drained(seen.select("user_id", "event_type"), "seen", "append")


@query("SELECT user_id, count(*) AS n, max(value) AS best FROM events GROUP BY user_id")
def stream_running_best(spark, d):
    return events.drained(events.running_best(events.stream(spark, d)), "best", "update", ["user_id"])


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM s)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, g"""
)
def sessions(spark, d):
    """The same operator over a table at rest."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e, "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
