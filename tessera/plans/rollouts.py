"""Queries on rollout tables, each with SQL of another formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded
from tessera.fixtures import trajectories
from tessera.operators import datasets, prefix, scores
from tessera.plans.registry import query
from tessera.sources.tables import table, union_with_offsets

T = """WITH t AS (
  SELECT user_id AS problem_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS trajectory_id, event_id,
    CASE WHEN value < 20 THEN CAST(0.0 AS DOUBLE) ELSE least(CAST(1.0 AS DOUBLE), value / 100) END AS final_reward,
    1 + event_id % 10 AS num_turns, event_type <> 'error' AS terminated, event_type = 'error' AS truncated, event_type AS source,
    CASE WHEN event_type IN ('view', 'click') THEN 'multi' ELSE 'single' END AS mode,
    CASE WHEN event_id % 7 = 0 THEN 'length' WHEN event_id % 11 = 0 THEN NULL ELSE 'stop' END AS finish_reason,
    CASE WHEN event_id % 9 = 0 THEN 0.0 WHEN value < 20 THEN 0.0 ELSE least(CAST(1.0 AS DOUBLE), value / 100) END AS rescored_reward,
    1 + event_id % 3 AS rsa_step
  FROM events),
l AS (SELECT problem_id, list(final_reward ORDER BY trajectory_id) AS r FROM t GROUP BY problem_id)"""

_FULL = "len(list_filter(r[1:k], lambda x: x = 1.0))"

SOURCES = ("click", "error", "purchase", "signup", "view")


def _by_source(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    t = trajectories(spark, folder)
    return [(s, t.where(F.col("source") == s)) for s in SOURCES]


@query(
    f"""{T} SELECT CAST(k AS INTEGER) AS k, count(*) AS n_problems, round(avg(list_max(r[1:k])), 8) AS best_at_k,
    round(avg(CASE WHEN list_contains(r[1:k], 1.0) THEN 1.0 ELSE 0.0 END), 8) AS pass_at_k, round(avg(list_avg(r[1:k])), 8) AS mean_at_k,
    round(avg({_FULL} / k), 8) AS success_at_k
    FROM (SELECT unnest(range(1, 1 + (SELECT max(len(r)) FROM l))) AS k) ks JOIN l ON len(r) >= k GROUP BY k"""
)
def prefix_curve(spark, d):
    return prefix.prefix_curve(trajectories(spark, d))


@query(
    f"""{T} SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN len(list_filter(r[1:k], lambda x: x > 0)) > 0 THEN 1.0 ELSE 0.0 END), 8) AS pass_at_k
    FROM (SELECT unnest([1, 2, 4, 8]) AS k) ks, l GROUP BY k"""
)
def pass_at_k_all(spark, d):
    return prefix.pass_at(trajectories(spark, d), [1, 2, 4, 8])


@query(
    f"""{T} SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN list_contains(r[1:k], 1.0) THEN 1.0 ELSE 0.0 END), 8) AS pass_at_k
    FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 50]) AS k) ks, l GROUP BY k"""
)
def pass_at_k_ladder(spark, d):
    return prefix.pass_at(trajectories(spark, d), prefix.ladder(50), prefix.FULL)


@query(
    f"""{T}, p AS (SELECT problem_id, rsa_step, max(final_reward) b, max(CASE WHEN final_reward = 1.0 THEN 1.0 ELSE 0.0 END) a, avg(final_reward) m,
    avg(CASE WHEN final_reward = 1.0 THEN 1.0 ELSE 0.0 END) s FROM t GROUP BY ALL)
    SELECT rsa_step, count(*) AS n_problems, round(avg(b), 8) AS best_at_step, round(avg(a), 8) AS pass_at_step, round(avg(m), 8) AS mean_at_step, round(avg(s), 8) AS success_at_step FROM p GROUP BY rsa_step"""
)
def best_pass_mean_success_at_step(spark, d):
    return prefix.at_step(trajectories(spark, d))


@query(
    f"""{T}, p AS (SELECT problem_id, rsa_step, list(final_reward ORDER BY trajectory_id) r FROM t GROUP BY ALL)
    SELECT rsa_step, round(sum(list_sum(r)) / sum(len(r)), 8) AS mean_accuracy, round(avg(CASE WHEN r[1] > 0 THEN 1.0 ELSE 0.0 END), 8) AS pass_at_1,
    round(avg(CASE WHEN list_max(r) > 0 THEN 1.0 ELSE 0.0 END), 8) AS pass_at_n, CAST(sum(len(list_filter(r, lambda x: x > 0))) AS BIGINT) AS successes,
    count(*) FILTER (list_max(r) > 0) AS solved FROM p GROUP BY rsa_step"""
)
def rsa_step_metrics(spark, d):
    return prefix.step_summary(trajectories(spark, d))


@query(
    f"""{T} SELECT count(*) AS n_rows, count(DISTINCT problem_id) AS n_problems, count(*) FILTER (final_reward > 0) AS n_success,
    count(DISTINCT problem_id) FILTER (final_reward > 0) AS n_solved, round(count(*) FILTER (final_reward > 0) / count(*), 8) AS success_rate FROM t"""
)
def run_summary(spark, d):
    return prefix.run_summary(trajectories(spark, d))


@query(f"{T} SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, count(*) AS n_problems FROM (SELECT count(*) n FROM t GROUP BY problem_id)")
def samples_per_problem(spark, d):
    return prefix.shortest(trajectories(spark, d))


@query(f"{T} SELECT problem_id, count(*) AS n_done, count(*) >= 64 AS complete FROM t GROUP BY problem_id")
def problem_completion(spark, d):
    return prefix.completion(trajectories(spark, d), 64)


@query(
    f"""{T}, p AS (SELECT CAST(k AS INTEGER) AS k, round(avg(list_avg(r[1:k])), 8) AS mean_at_k FROM (SELECT unnest(range(1, 1 + (SELECT max(len(r)) FROM l))) AS k) ks JOIN l ON len(r) >= k GROUP BY k)
    SELECT k, mean_at_k, k * 10 AS forward_passes FROM p"""
)
def curve_by_forward_passes(spark, d):
    return prefix.forward_passes(prefix.prefix_curve(trajectories(spark, d))).select("k", "mean_at_k", "forward_passes")


_OFFSETS = "CASE source WHEN 'click' THEN 0 WHEN 'error' THEN 1000 WHEN 'purchase' THEN 2000 WHEN 'signup' THEN 3000 ELSE 4000 END"


@query(f"{T} SELECT problem_id + {_OFFSETS} AS problem_id, trajectory_id, final_reward FROM t WHERE problem_id + {_OFFSETS} >= 1003 AND problem_id + {_OFFSETS} < 3010")
def union_offset_bounds(spark, d):
    frames = [(df, 1000 * i) for i, (_, df) in enumerate(_by_source(spark, d))]
    return union_with_offsets(frames, 1003, 3010).select("problem_id", "trajectory_id", "final_reward")


@query(f"{T} SELECT problem_id + {_OFFSETS} AS problem_id, trajectory_id, rescored_reward AS final_reward FROM t")
def union_rescored(spark, d):
    frames = [(df, 1000 * i) for i, (_, df) in enumerate(_by_source(spark, d))]
    return union_with_offsets(frames, reward="rescored_reward").select("problem_id", "trajectory_id", "final_reward")


_MODES = "a AS (SELECT * FROM t WHERE mode = 'single' AND problem_id % 5 <> 0), b AS (SELECT * FROM t WHERE mode = 'multi' AND problem_id % 3 <> 0), c AS (SELECT problem_id FROM a INTERSECT SELECT problem_id FROM b)"


@query(
    f"""{T}, {_MODES}, u AS (SELECT 'single' AS side, * FROM a UNION ALL SELECT 'multi', * FROM b), g AS (SELECT side, problem_id, list(final_reward ORDER BY trajectory_id) r FROM u WHERE problem_id IN (SELECT problem_id FROM c) GROUP BY ALL)
    SELECT side, CAST(k AS INTEGER) AS k, count(*) AS n_problems, round(avg(list_max(r[1:k])), 8) AS best_at_k, round(avg(CASE WHEN list_contains(r[1:k], 1.0) THEN 1.0 ELSE 0.0 END), 8) AS pass_at_k,
    round(avg(list_avg(r[1:k])), 8) AS mean_at_k, round(avg({_FULL} / k), 8) AS success_at_k FROM (SELECT unnest(range(1, 1 + (SELECT max(len(r)) FROM g))) AS k) ks JOIN g ON len(r) >= k GROUP BY ALL"""
)
def common_problems_compare(spark, d):
    t = trajectories(spark, d)
    a = t.where("mode = 'single' and problem_id % 5 <> 0")
    b = t.where("mode = 'multi' and problem_id % 3 <> 0")
    ids = datasets.common_problems(a, b)
    curves = [prefix.prefix_curve(datasets.restricted(x, ids)).select(F.lit(n).alias("side"), "*") for n, x in (("single", a), ("multi", b))]
    return curves[0].unionByName(curves[1])


@query(
    f"""{T}, x AS (SELECT source, max(problem_id) + 1 AS n FROM t GROUP BY source), o AS (SELECT source, CAST(coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM x)
    SELECT problem_id + o AS problem_id, trajectory_id, problem_id AS original_problem_id, trajectory_id AS original_trajectory_id, source AS source_dataset FROM t JOIN o USING (source)"""
)
def merge_offsets(spark, d):
    return datasets.merged(_by_source(spark, d)).select("problem_id", "trajectory_id", "original_problem_id", "original_trajectory_id", "source_dataset")


@query(
    f"""{T}, x AS (SELECT source, max(problem_id) + 1 AS n FROM t GROUP BY source), o AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM x)
    SELECT count(*) AS n_rows, count(DISTINCT problem_id + o) AS n_problems, count(*) FILTER (terminated AND final_reward = 1.0 OR final_reward > 0) AS n_success, count(DISTINCT problem_id + o) FILTER (terminated AND final_reward = 1.0 OR final_reward > 0) AS n_solved,
    round(count(*) FILTER (final_reward > 0) / count(*), 8) AS success_rate FROM t JOIN o USING (source)"""
)
def merge_metadata(spark, d):
    frame = datasets.merged(_by_source(spark, d)).withColumn("is_successful", F.col("terminated") & (F.col("final_reward") == 1.0))
    return prefix.run_summary(frame, prefix.FLAGGED)


@query(f"{T} SELECT problem_id, max(trajectory_id) + 1 AS num_trajectories FROM t GROUP BY problem_id")
def trajectory_extents(spark, d):
    return datasets.id_extents(trajectories(spark, d))


_HARD = f"{T}, {_MODES}, h AS (SELECT problem_id, round(len(list_filter(r[1:32], lambda x: x = 1.0)) / 32, 8) AS success_rate FROM l WHERE len(r) >= 32 AND problem_id IN (SELECT problem_id FROM b)), k AS (SELECT *, row_number() OVER (ORDER BY success_rate, problem_id) - 1 AS rank FROM h)"


@query(f"{_HARD} SELECT problem_id, success_rate, rank FROM k")
def hardest_rank(spark, d):
    t = trajectories(spark, d)
    return datasets.hardest(t, 32, t.where("mode = 'multi' and problem_id % 3 <> 0"))


@query(f"{_HARD} SELECT p_partkey, p_name, p_partkey AS original_problem_id, row_number() OVER (ORDER BY rank) - 1 AS problem_id FROM k JOIN part ON p_partkey = k.problem_id WHERE rank < 10")
def hardest_topx_rows(spark, d):
    return datasets.hardest_rows(hardest_rank(spark, d), table(spark, d, "part").select("p_partkey", "p_name"), 10, "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 17 <> 0 AND p_size / 50.0 BETWEEN 0.1 AND 0.3")
def difficulty_closed_range(spark, d):
    p = table(spark, d, "part").withColumn("difficulty", F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") / 50.0))
    return p.where(datasets.in_closed_range(F.col("difficulty"), 0.1, 0.3)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE coalesce(CASE WHEN p_partkey % 17 <> 0 THEN p_size / 50.0 END, 0) BETWEEN 0 AND 0.3")
def difficulty_missing_is_zero(spark, d):
    p = table(spark, d, "part").withColumn("difficulty", F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") / 50.0))
    return p.where(datasets.in_closed_range(F.col("difficulty"), 0.0, 0.3, 0.0)).select("p_partkey")


@query("SELECT CAST(max(s) AS DOUBLE) AS high, CAST(min(s) AS DOUBLE) AS low, round(avg(s), 8) AS mean, count(s) AS n FROM (SELECT CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS DOUBLE) / 50.0 END AS s FROM part)")
def difficulty_stats(spark, d):
    s = F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") / 50.0)
    return table(spark, d, "part").select(s.alias("s")).agg(F.max("s").alias("high"), F.min("s").alias("low"), rounded(F.avg("s"), 8).alias("mean"), F.count("s").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-05-01'")
def date_half_open(spark, d):
    return table(spark, d, "orders").where(datasets.in_half_open(F.col("o_orderdate"), "1995-02-01", "1995-05-01")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CASE o_orderkey % 4 WHEN 3 THEN FALSE ELSE date_trunc('day', o_orderdate) >= TIMESTAMP '1995-02-01' AND date_trunc('day', o_orderdate) < TIMESTAMP '1995-05-01' END")
def contest_dates(spark, d):
    """Dates as text of several forms; a quarter can't be read."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, F.concat(day, F.lit("T00:00:00.123"))).when(k == 1, F.concat(day, F.lit(" 00:00"))).when(k == 2, day).otherwise("soon")
    return o.where(datasets.in_half_open(datasets.contest_date(text).cast("timestamp_ntz"), "1995-02-01", "1995-05-01")).select("o_orderkey")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 30 OFFSET 20")
def slice_problems(spark, d):
    return datasets.positional(table(spark, d, "part").select("p_partkey"), "p_partkey", 20, 30)


@query("SELECT p_partkey FROM (SELECT * FROM part ORDER BY p_partkey OFFSET 50) WHERE p_size BETWEEN 10 AND 20")
def skip_then_filter(spark, d):
    return datasets.positional(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", 50, None).where("p_size between 10 and 20").select("p_partkey")


@query(f"{T} SELECT problem_id, trajectory_id, rescored_reward AS final_reward, final_reward AS old_final_reward, rescored_reward - final_reward AS reward_diff, rescored_reward > 0 AS rescored_is_successful FROM t")
def rescore_delta(spark, d):
    return scores.rescored(trajectories(spark, d)).select("problem_id", "trajectory_id", "final_reward", "old_final_reward", "reward_diff", "rescored_is_successful")


@query(
    f"""{T}, g AS (SELECT problem_id, list(rescored_reward ORDER BY trajectory_id) r FROM t GROUP BY problem_id),
    p AS (SELECT k, round(avg(CASE WHEN len(list_filter(r[1:k], lambda x: x > 0)) > 0 THEN 1.0 ELSE 0.0 END), 8) v FROM (SELECT unnest([1, 2, 4, 8]) k) ks, g GROUP BY k)
    SELECT count(*) AS n_rows, count(DISTINCT problem_id) AS n_problems, round(count(*) FILTER (final_reward > 0) / count(*), 8) AS original_success_rate, round(count(*) FILTER (rescored_reward > 0) / count(*), 8) AS new_success_rate,
    round(count(*) FILTER (abs(rescored_reward - final_reward) < 0.01) / count(*), 8) AS reward_match_rate, (SELECT CAST(len(r) AS BIGINT) FROM g ORDER BY problem_id LIMIT 1) AS samples_per_problem,
    (SELECT v FROM p WHERE k = 1) AS pass_at_1, (SELECT v FROM p WHERE k = 2) AS pass_at_2, (SELECT v FROM p WHERE k = 4) AS pass_at_4, (SELECT v FROM p WHERE k = 8) AS pass_at_8 FROM t"""
)
def rescore_metrics(spark, d):
    return scores.rescore_metrics(scores.rescored(trajectories(spark, d)))


@query(
    f"""{T} SELECT mode, count(*) AS n_rows, count(*) FILTER (rescored_reward - final_reward > 0.001) AS improved, count(*) FILTER (rescored_reward - final_reward < -0.001) AS degraded,
    round(1 - count(*) FILTER (abs(rescored_reward - final_reward) > 0.001) / count(*), 8) AS match_rate FROM t GROUP BY ROLLUP (mode)"""
)
def parity_breakdown(spark, d):
    return scores.discrepancies(scores.rescored(trajectories(spark, d)), "mode")


_BROKEN_DOWN = "count(*) AS n_rows, count(*) FILTER (final_reward > 0) AS any_pass, count(*) FILTER (final_reward = 1.0) AS perfect, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (num_turns = 1) AS n_invalidated, round(avg(final_reward), 8) AS mean_reward"


@query(f"{T} SELECT mode, {_BROKEN_DOWN} FROM t GROUP BY ROLLUP (mode)")
def evaluation_breakdown(spark, d):
    return scores.breakdown(trajectories(spark, d).withColumn("invalidated", F.col("num_turns") == 1), "mode")


@query(f"{T}, y AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'function' ELSE 'stdin' END AS problem_type FROM t) SELECT problem_type, {_BROKEN_DOWN} FROM y GROUP BY ROLLUP (problem_type)")
def problem_type_breakdown(spark, d):
    t = trajectories(spark, d).withColumns({"invalidated": F.col("num_turns") == 1, "fn_name": F.when(F.col("event_id") % 3 == 0, "f").when(F.col("event_id") % 3 == 1, "")})
    return scores.by_problem_type(t)


@query(
    f"""{T} SELECT problem_id, trajectory_id, final_reward AS original_reward, rescored_reward AS new_reward, rescored_reward - final_reward AS diff,
    CASE WHEN rescored_reward - final_reward > 0.001 THEN 'improved' WHEN rescored_reward - final_reward < -0.001 THEN 'degraded' ELSE 'same' END AS change FROM t WHERE event_id % 4 <> 0"""
)
def parity_of_runs(spark, d):
    t = trajectories(spark, d)
    old = t.withColumn("final_reward", F.when(F.col("event_id") % 4 != 0, F.col("final_reward")))
    return scores.parity(old, t.withColumn("final_reward", F.col("rescored_reward")), ["problem_id", "trajectory_id"])


@query(f"{T} SELECT problem_id, trajectory_id, count(*) AS num_interactions, count(*) FILTER (k <> 1) AS successes, count(*) FILTER (k = 1) AS failures, round(sum(final_reward + k), 6) AS total_duration_ms FROM t, (SELECT unnest(range(3)) AS k) WHERE k < num_turns GROUP BY ALL")
def interaction_rollup(spark, d):
    runs = trajectories(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("k < num_turns")
    return scores.interaction_rollup(runs.select("problem_id", "trajectory_id", (F.col("k") != 1).alias("ok"), (F.col("final_reward") + F.col("k")).alias("duration_ms")))


@query(f"{T} SELECT problem_id, trajectory_id, CAST(k AS INTEGER) AS pos, 'print(' || k || ')' AS code FROM t, (SELECT unnest([0, 2]) AS k)")
def interaction_codes(spark, d):
    """Of three interactions the middle one is blank."""
    made = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.when(k == 1, " \n\t").otherwise(F.concat(F.lit("print("), k.cast("string"), F.lit(")"))).alias("code")))
    return datasets.interaction_codes(trajectories(spark, d).withColumn("interactions", made))


@query(f"{T} SELECT problem_id, trajectory_id, final_reward FROM t WHERE problem_id < 50")
def first_problems(spark, d):
    """All samples of the first fifty problems: the operator is that limit."""
    return datasets.first_problems(trajectories(spark, d), 50).select("problem_id", "trajectory_id", "final_reward")


@query(f"{T}, n AS (SELECT event_id, row_number() OVER (ORDER BY problem_id, trajectory_id) - 1 AS i FROM t) SELECT i // 4 AS prompt_index, string_agg(event_id, ',' ORDER BY i) AS answers FROM n GROUP BY i // 4")
def choices_by_prompt(spark, d):
    """All samples as answers numbered through, four for each prompt in order."""
    rows = datasets.numbered(trajectories(spark, d), ["problem_id", "trajectory_id"], "index").select("index", "event_id")
    out = datasets.choices_by_prompt(rows, 4)
    return out.select("prompt_index", F.array_join(F.transform("sequences", lambda x: x["event_id"].cast("string")), ",").alias("answers"))


@query("SELECT event_id, CAST(event_id % 3 AS INTEGER) AS client, value * 2 AS answer FROM events")
def shards_reassembled(spark, d):
    asked = datasets.sharded(table(spark, d, "events").select("event_id", "value"), "event_id", 3)
    answers = asked.select("event_id", (F.col("value") * 2).alias("answer"))
    return datasets.reassembled(asked.select("event_id", "client"), answers, "event_id")


@query("WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part) SELECT p_partkey, (pos + t * n) // 48 AS batch FROM p, (SELECT unnest(range(200)) AS t) WHERE pos + t * n < 48 * 50")
def cycled_batches(spark, d):
    return datasets.cycled(table(spark, d, "part").select("p_partkey"), "p_partkey", 48, 50)


@query(f"{T}, g AS (SELECT problem_id, list([final_reward, rescored_reward] ORDER BY trajectory_id) AS r FROM t GROUP BY problem_id) SELECT problem_id, round(list_avg(flatten(r)), 8) AS mean_reward FROM g")
def nested_reward_mean(spark, d):
    from tessera.functions.nested import mean_of_nested

    g = trajectories(spark, d).groupBy("problem_id").agg(F.collect_list(F.array("final_reward", "rescored_reward")).alias("r"))
    return g.select("problem_id", rounded(mean_of_nested("r"), 8).alias("mean_reward"))


@query(f"{T} SELECT mode, round(avg(num_turns * 100), 8) AS mean_tokens FROM t GROUP BY mode")
def mean_tokens(spark, d):
    return prefix.mean_tokens(trajectories(spark, d).withColumn("total_tokens", F.col("num_turns") * 100), ["mode"])


@query(
    """WITH s AS (SELECT event_type, list(value ORDER BY value) v, count(*) n, avg(value) a, median(value) m, stddev_samp(value) sd, count(*) FILTER (value >= 90) late FROM events GROUP BY event_type)
    SELECT event_type, n, round(a, 6) AS mean, round(m, 6) AS median, round(coalesce(sd, 0), 6) AS stdev, v[1] AS low, v[n] AS high,
    CASE WHEN n >= 10 THEN v[n * 10 // 100 + 1] ELSE 0 END AS p10, CASE WHEN n >= 10 THEN v[n * 90 // 100 + 1] ELSE 0 END AS p90, CASE WHEN n >= 100 THEN v[n * 99 // 100 + 1] ELSE 0 END AS p99, late AS timeouts FROM s"""
)
def latency_stats(spark, d):
    return scores.latency(table(spark, d, "events"), "value", ["event_type"], slow=90.0)


@query(f"{T} SELECT problem_id, trajectory_id, final_reward FROM t WHERE problem_id = 3 AND final_reward > 0 AND num_turns BETWEEN 2 AND 7")
def viewer_filter(spark, d):
    return scores.viewed(trajectories(spark, d), problem=3, success=True, turns=(2, 7)).select("problem_id", "trajectory_id", "final_reward")


@query(
    f"""{T} SELECT count(*) AS total, count(*) FILTER (final_reward > 0) AS successes, round(100 * (count(*) FILTER (final_reward > 0) / count(*)), 8) AS pass_rate, round(avg(num_turns), 8) AS avg_turns,
    count(*) FILTER (problem_id = 3 AND final_reward > 0 AND num_turns BETWEEN 2 AND 7) AS shown FROM t"""
)
def viewer_stats(spark, d):
    t = trajectories(spark, d)
    return scores.viewer_stats(t, scores.viewed(t, problem=3, success=True, turns=(2, 7)))


@query(f"{T} SELECT DISTINCT problem_id FROM t WHERE truncated")
def viewer_choices(spark, d):
    return trajectories(spark, d).where("truncated").select("problem_id").distinct()


@query(f"{T} SELECT mode, CASE WHEN finish_reason IS NULL AND num_turns >= 8 THEN 'length' ELSE finish_reason END AS reason, count(*) AS n FROM t GROUP BY ALL")
def finish_reason_counts(spark, d):
    from tessera.operators.turns import inferred_finish

    return trajectories(spark, d).withColumn("reason", inferred_finish("finish_reason", F.col("num_turns"), 8)).groupBy("mode", "reason").agg(F.count("*").alias("n"))


@query(
    f"""{T}, g AS (SELECT problem_id, list(finish_reason ORDER BY trajectory_id) r FROM t GROUP BY problem_id)
    SELECT problem_id, CAST(len(list_filter(r, lambda x: x = 'length')) AS INTEGER) AS n_cut, CAST(len(r) - len(list_filter(r, lambda x: x = 'length')) AS INTEGER) AS n_whole FROM g"""
)
def truncation_counts(spark, d):
    from tessera.operators.turns import truncation_counts as counts

    g = trajectories(spark, d).groupBy("problem_id").agg(F.transform(F.collect_list(F.struct("finish_reason")), lambda x: x["finish_reason"]).alias("r"))
    cut, whole = counts("r")
    return g.select("problem_id", cut.alias("n_cut"), whole.alias("n_whole"))


@query(
    f"""{T}, c AS (SELECT problem_id, rsa_step, row_number() OVER (PARTITION BY problem_id, rsa_step ORDER BY trajectory_id) - 1 AS candidate_id, event_id, final_reward FROM t),
    e AS (SELECT problem_id, rsa_step, candidate_id, unnest([0, 1]) AS pos, unnest([candidate_id, candidate_id + 1]) AS parent FROM c WHERE rsa_step > 1)
    SELECT e.problem_id, e.rsa_step, e.candidate_id, string_agg(CAST(c.event_id AS VARCHAR), ',' ORDER BY pos) AS parents FROM e JOIN c ON c.problem_id = e.problem_id AND c.rsa_step = e.rsa_step - 1 AND c.candidate_id = e.parent GROUP BY ALL"""
)
def rsa_lineage(spark, d):
    from pyspark.sql import Window

    from tessera.operators.turns import lineage

    c = trajectories(spark, d).withColumn("candidate_id", (F.row_number().over(Window.partitionBy("problem_id", "rsa_step").orderBy("trajectory_id")) - 1).cast("long"))
    parents = F.when(F.col("rsa_step") > 1, F.array("candidate_id", F.col("candidate_id") + 1)).otherwise(F.array().cast("array<bigint>"))
    c = c.select("problem_id", "rsa_step", "candidate_id", F.col("event_id").cast("string").alias("response"), parents.alias("aggregated_from"))
    return lineage(c).withColumn("parents", F.array_join("parents", ","))


@query(f"{T} SELECT problem_id, trajectory_id, round((final_reward - avg(final_reward) OVER ()) / (stddev_samp(final_reward) OVER () + 1e-8), 6) AS advantage FROM t")
def grpo_batch(spark, d):
    return scores.batch_advantages(trajectories(spark, d)).select("problem_id", "trajectory_id", rounded("advantage", 6).alias("advantage"))


@query(f"{T} SELECT problem_id, trajectory_id, round((final_reward - avg(final_reward) OVER w) / (stddev_samp(final_reward) OVER w + 1e-8), 6) AS advantage FROM t WINDOW w AS (PARTITION BY problem_id)")
def grpo_group(spark, d):
    t = trajectories(spark, d)
    return t.select("problem_id", "trajectory_id", rounded(scores.group_advantages(["problem_id"]), 6).alias("advantage"))


_V = "WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS a, list_reverse([CAST(x AS DOUBLE) for x in embedding]) AS b, CAST(label AS DOUBLE) - 4.5 AS adv FROM embeddings), i AS (SELECT vec_id, adv, unnest(a) AS x, unnest(b) AS y, unnest(range(len(a))) AS p FROM v)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    a = F.col("embedding").cast("array<double>")
    e = e.select("vec_id", a.alias("a"), F.reverse(a).alias("b"), (F.col("label") - 4.5).cast("double").alias("adv"))
    return e.withColumn("mask", scores.completion_mask(F.size("a"), F.lit(16)))


@query(f"{_V} SELECT vec_id, round(sum(-least(exp(x - y) * adv, greatest(0.8, least(1.2, exp(x - y))) * adv)) FILTER (p >= 16) / greatest(count(*) FILTER (p >= 16), 1), 6) AS loss FROM i GROUP BY vec_id")
def ppo_masked(spark, d):
    return _vectors(spark, d).select("vec_id", rounded(scores.clipped_loss(F.col("a"), F.col("b"), F.col("adv"), F.col("mask")), 6).alias("loss"))


@query(f"{_V} SELECT vec_id, round(sum(x - y) FILTER (p >= 16) / greatest(count(*) FILTER (p >= 16), 1), 6) AS kl FROM i GROUP BY vec_id")
def kl_masked(spark, d):
    return _vectors(spark, d).select("vec_id", rounded(scores.kl_penalty(F.col("a"), F.col("b"), F.col("mask")), 6).alias("kl"))


@query(f"{_V} SELECT vec_id, round(-sum(x) FILTER (p >= 16) / greatest(count(*) FILTER (p >= 16), 1), 6) AS loss FROM i GROUP BY vec_id")
def cross_entropy(spark, d):
    return _vectors(spark, d).select("vec_id", rounded(scores.cross_entropy(F.col("a"), F.col("mask")), 6).alias("loss"))


@query(f"{_V}, s AS (SELECT vec_id, ln(sum(exp(x))) AS z FROM i GROUP BY vec_id) SELECT vec_id, round(x - z, 6) AS log_prob FROM i JOIN s USING (vec_id) WHERE p = vec_id % 64")
def log_softmax(spark, d):
    at = (F.col("vec_id") % 64).cast("int")
    return _vectors(spark, d).select("vec_id", rounded(scores.log_softmax_at(F.col("a"), at), 6).alias("log_prob"))


@query(f"{T} SELECT problem_id, round(avg(final_reward) FILTER (NOT truncated), 8) AS known_rate, round(avg(final_reward) + 0.5 * avg(num_turns), 8) AS score FROM t GROUP BY problem_id")
def weighted_rubric(spark, d):
    g = trajectories(spark, d).groupBy("problem_id").agg(F.avg("final_reward").alias("passed"), F.avg("num_turns").alias("turns"), F.avg(F.when(~F.col("truncated"), F.col("final_reward"))).alias("known"))
    return g.select("problem_id", rounded("known", 8).alias("known_rate"), rounded(scores.weighted({"passed": F.col("passed"), "turns": F.col("turns"), "other": F.lit(3.0)}, {"passed": 1.0, "turns": 0.5}), 8).alias("score"))


@query("SELECT source, round(avg(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 END), 8) AS pass_rate, count(quality) > 0 AND count(*) FILTER (quality = 0) = 0 AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def sandbox_pass_rate(spark, d):
    """Tests without a result (here documents without a label) don't count."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(rounded(scores.rate_of_known(F.col("quality") == 1), 8).alias("pass_rate"), scores.all_passed(F.col("quality") == 1).alias("passed"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backfill_missing(spark, d):
    return datasets.missing_from(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    """SELECT CASE WHEN doc_id % 13 = 0 THEN 'missing_response' WHEN l.doc_id IS NULL THEN 'missing_tests' ELSE 'used' END AS status, count(*) AS n
    FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL"""
)
def row_status_counters(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("has")).distinct(), "doc_id", "left")
    status = F.when(F.col("doc_id") % 13 == 0, "missing_response").when(F.col("has").isNull(), "missing_tests").otherwise("used")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"{T} SELECT DISTINCT source, problem_id FROM t")
def problem_sets_by_type(spark, d):
    return trajectories(spark, d).select("source", "problem_id").distinct()


@query("SELECT CAST(sum(CASE WHEN value >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS timeouts, round(avg(CASE WHEN value >= 90 THEN 1.0 ELSE 0.0 END), 8) AS rate, count(DISTINCT user_id) FILTER (value >= 90) AS users FROM events")
def timeout_totals(spark, d):
    e, late = table(spark, d, "events"), F.col("value") >= 90
    return e.agg(F.count_if(late).alias("timeouts"), rounded(F.avg(F.when(late, 1.0).otherwise(0.0)), 8).alias("rate"), F.countDistinct(F.when(late, F.col("user_id"))).alias("users"))


@query(
    """SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0
    EXCEPT SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"""
)
def join_and_difference(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return both.where("c_acctbal > 0").select("c_custkey", "o_orderkey").exceptAll(both.where("o_orderstatus = 'F'").select("c_custkey", "o_orderkey"))


@query("SELECT event_id, p_partkey FROM events JOIN part ON event_id >= p_partkey * 7 AND event_id < p_partkey * 7 + p_size")
def range_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7).alias("low"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("high"))
    return datasets.range_join(table(spark, d, "events").select("event_id"), p, "event_id", "low", "high", 64).select("event_id", "p_partkey")


@query("SELECT a.event_id, b.value AS newest FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'click'")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("newest"))
    return datasets.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", "newest").select("event_id", "newest")


@query(f"{T} SELECT mode, source, count(*) AS n, round(avg(final_reward), 8) AS mean FROM t GROUP BY CUBE (mode, source)")
def reward_cube(spark, d):
    return trajectories(spark, d).cube("mode", "source").agg(F.count("*").alias("n"), rounded(F.avg("final_reward"), 8).alias("mean"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5(concat_ws(',', 42, p_partkey)), p_partkey) - 1 AS position FROM part")
def seeded_shuffle(spark, d):
    return datasets.seeded_order(table(spark, d, "part").select("p_partkey"), "p_partkey")


@query("SELECT p_partkey, string_agg(i, ' ' ORDER BY k) AS tests FROM (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws(',', 42, p_partkey, i))) AS k FROM part, (SELECT unnest(range(50)) AS i)) WHERE k <= 15 GROUP BY p_partkey")
def seeded_test_subset(spark, d):
    subset = datasets.seeded_subset(F.sequence(F.lit(0), F.lit(49)), 15, F.lit(42), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.array_join(subset, " ").alias("tests"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 32 AS batch FROM part")
def prompt_batches(spark, d):
    return datasets.batches(table(spark, d, "part").select("p_partkey"), "p_partkey", 32)


@query("SELECT p_partkey, CAST(s AS INTEGER) AS sample_index FROM part, (SELECT unnest(range(8)) AS s)")
def seed_rollouts(spark, d):
    return datasets.seeded_rollouts(table(spark, d, "part").select("p_partkey"), 8)
