"""Rollouts as keyed state: answers come as a stream, each moves its rollout on.

The state of a rollout (problem, sample) is its turn, whether it has interacted and
its late runs; answers that come before their turn wait there, those of a batch that are
in turn move it on at once.  Event time ends a rollout whose next answer doesn't come.
The rules are the batch environment's, and so are the programs' limits; a rollout that
is over leaves a mark, so that a repeated answer doesn't begin it anew.

Rollouts are dealt out to buckets, and a bucket is the key of the state: a batch reads,
writes and times a bucket once, however many of its rollouts move on, where a rollout as a
key would cost several calls of the state store and frames of its own.  A bucket's rollouts, its marks (12 bytes each)
and its answers of a batch are in memory at once."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tessera.functions.text import interact_last_open
from tessera.operators.harness import Child, run_cases, run_snippet
from tessera.operators.scores import classified

KEYS = ["problem_id", "trajectory_id"]
#: Buckets of rollouts; a stream that goes on from a checkpoint has to keep their number.
BUCKETS = 2048
ENDED = "problem_id long, trajectory_id int, n_turns int, final_reward double, terminated boolean, truncated boolean, has_interacted boolean, eval_timeouts long, interaction_timeouts long, answered boolean"
_NAMES = [x.split()[0] for x in ENDED.split(", ")]
# types of a worker's state are spelled out: it has no session that could read them
_KEY = [StructField("problem_id", LongType()), StructField("trajectory_id", IntegerType())]
_TURN = StructType([*_KEY, StructField("turn", IntegerType())])
_ROLLOUT = StructType([*_KEY, StructField("current_turn", IntegerType()), StructField("has_interacted", BooleanType()), StructField("eval_timeouts", LongType()), StructField("interaction_timeouts", LongType()), StructField("due", LongType()), StructField("waiting", ArrayType(IntegerType()))])
_BUCKET = StructType([StructField("timer", LongType()), StructField("rollouts", ArrayType(_ROLLOUT)), StructField("over_problems", ArrayType(LongType())), StructField("over_trajectories", ArrayType(IntegerType()))])
_WAITING = StructType([*[StructField(c, StringType()) for c in ("interact_code", "code", "verdict", "fn_name")], *[StructField(c, ArrayType(StringType())) for c in ("inputs", "outputs")]])
#: Results of programs that a task keeps, the last used of them.
KEPT = 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rollout(StatefulProcessor):
    """Moves the rollouts of a bucket on by their answers in order of turn; ends them by
    their rules. A rollout is [current_turn, has_interacted, eval_timeouts,
    interaction_timeouts, when it is due, turns of the answers that wait]."""

    def __init__(self, max_turns: int, seconds: float, patience_ms: int, max_tests: int = 15):
        self.max_turns, self.seconds, self.patience, self.max_tests = max_turns, seconds, patience_ms, max_tests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _BUCKET)
        self.waiting = handle.getMapState("waiting", _TURN, _WAITING)
        self.child, self.results = Child(), OrderedDict()

    def close(self) -> None:
        self.child.__exit__()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, active, over = self._read()
        newest, come = {}, {}
        for pair, turn, ms, answer in self._answers(rows):
            if pair in over:
                continue
            newest[pair] = max(newest.get(pair, 0), ms)
            state = active.setdefault(pair, [0, False, 0, 0, 0, []])
            if state[0] < turn <= self.max_turns and turn not in state[5]:
                come.setdefault(pair, {}).setdefault(turn, answer)  # the first of a turn counts
        watermark, ended = timerValues.getCurrentWatermarkInMs(), []
        for pair, ms in newest.items():
            state = active[pair]
            end = self._moved(pair, state, come.pop(pair, {}))
            if end is not None:
                ended.append(self._over(pair, active, over, *end, True))
            else:
                state[4] = max(ms + self.patience, watermark + self.patience, state[4])
        if newest:
            self._write(timer, active, over)
        if ended:
            yield pd.DataFrame(ended, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, active, over = self._read()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        late = [pair for pair, state in active.items() if state[4] <= now]
        ended = [self._over(pair, active, over, 0.0, False, True, False) for pair in late]
        self._write(0, active, over)  # the timer that has expired goes by itself
        if ended:
            yield pd.DataFrame(ended, columns=_NAMES)

    def _read(self) -> tuple[int, dict, dict]:
        """(the bucket's timer, its rollouts by key, the keys of those that are over)"""
        timer, rollouts, problems, trajectories = self.bucket.get() or (0, [], [], [])
        return timer, {(r[0], r[1]): [*r[2:7], list(r[7])] for r in rollouts}, dict.fromkeys(zip(problems, trajectories))

    def _write(self, timer: int, active: dict, over: dict) -> None:
        due = min((state[4] for state in active.values()), default=0)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.bucket.update((due, [(*pair, *state) for pair, state in active.items()], [p for p, _ in over], [t for _, t in over]))

    @staticmethod
    def _answers(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(key, turn, ms, answer) of the rows; the tests of a problem are kept once."""
        tests: dict = {}
        for frame in rows:
            numbers = [frame[c].fillna(0).astype("int64").tolist() for c in ("problem_id", "turn", "ms")]
            samples = frame["trajectory_id"]
            samples = [None if x != x else int(x) for x in samples.tolist()] if samples.hasnans else samples.tolist()
            for problem, turn, ms, sample, *answer in zip(*numbers, samples, *(frame[c].tolist() for c in _WAITING.fieldNames())):
                if answer[4] is not None or answer[5] is not None:
                    lists = [None if v is None else [None if x is None else str(x) for x in v] for v in answer[4:]]
                    known = tests.setdefault(problem, lists)
                    answer[4:] = known if known == lists else lists
                yield (problem, sample), turn, ms, tuple(answer)

    def _moved(self, pair: tuple, state: list, come: dict) -> tuple[float, bool, bool] | None:
        """Takes the answers that are in turn, and keeps the others until they are:
        (reward, terminated, truncated) if the rollout ends."""
        waited, end = set(state[5]), None
        while end is None and ((turn := state[0] + 1) in come or turn in waited):
            if turn in waited:
                answer = self.waiting.getValue((*pair, turn))
                self._forget(pair, state, [turn])
                waited.remove(turn)
            else:
                answer = come.pop(turn)
            end = self._step(state, *answer)
        if end is None:
            for turn, answer in come.items():
                self.waiting.updateValue((*pair, turn), answer)
                state[5].append(turn)
        return end

    def _forget(self, pair: tuple, state: list, turns: list[int]) -> None:
        for turn in turns:
            self.waiting.removeKey((*pair, turn))
        state[5] = [turn for turn in state[5] if turn not in turns]

    def _result(self, run, *program):
        """What a program gives; equal ones share a run while a task keeps its result."""
        name = hashlib.sha256(repr(program).encode()).digest()
        if name not in self.results:
            self.results[name] = run(self.child, *program)
        self.results.move_to_end(name)
        if len(self.results) > KEPT:
            self.results.popitem(last=False)
        return self.results[name]

    def _step(self, state: list, interact_code, code, verdict, fn_name, inputs, outputs) -> tuple[float, bool, bool] | None:
        """(reward, terminated, truncated) if the rollout ends with this answer."""
        state[0] += 1
        last = state[0] >= self.max_turns
        if interact_code:
            _, _, errors = self._result(run_snippet, interact_code, self.seconds)
            state[1], state[3] = True, state[3] + ("timed out" in (errors or "").lower())
        elif code and state[1]:
            if verdict != "execute":
                return 0.0, True, True
            passed, total, late = self._result(run_cases, code, list(inputs or []), list(outputs or []), fn_name or None, self.seconds, self.max_tests)
            state[2] += len(late)
            return (passed / total if total else 0.0), True, False
        return (0.0, False, True) if last else None

    def _over(self, pair: tuple, active: dict, over: dict, reward: float, terminated: bool, truncated: bool, answered: bool) -> list:
        """The row of a rollout that ends here; its mark stays."""
        state = active.pop(pair)
        self._forget(pair, state, state[5])
        over[pair] = None
        return [*pair, state[0], reward, terminated, truncated, state[1], state[2], state[3], answered]


def ended_rollouts(answers: DataFrame, problems: DataFrame, max_turns: int = 5, seconds: float = 1.0, patience: str = "10 minutes", late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """A stream of ended rollouts (ENDED) from a stream of answers: problem_id,
    trajectory_id, turn (from 1; 0 begins a rollout), action and ts.

    *problems* (problem_id, fn_name, tests) is a table. Answers may come in any order
    and more than once; the first of a turn counts. A rollout that isn't answered for
    *patience* of event time is cut short with reward 0 and *answered* false. Null
    actions are invalid; answers to unknown problems are left out. More *buckets* take
    less memory each and more calls of the state store."""
    fields = problems.select("problem_id", "fn_name", F.col("tests.inputs").alias("inputs"), F.col("tests.outputs").alias("outputs"))
    told = classified(answers.withWatermark("ts", late).join(fields, "problem_id"), "action").withColumn("interact_code", F.nullif(interact_last_open("action"), F.lit("")))
    scored = F.col("interact_code").isNull() & (F.col("verdict") == "execute")  # only these are run on tests
    keys = [F.col("problem_id").cast("long").alias("problem_id"), F.col("trajectory_id").cast("int").alias("trajectory_id")]
    rows = told.select(*keys, F.col("turn").cast("int").alias("turn"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "interact_code", "code", "verdict", "fn_name", *[F.when(scored, F.col(c)).alias(c) for c in ("inputs", "outputs")])
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    answers.sparkSession.conf.set(_PROVIDER, _ROCKS)  # what keyed state with timers needs
    return dealt.groupBy("bucket").transformWithStateInPandas(Rollout(max_turns, seconds, ms), outputStructType=ENDED, outputMode="Append", timeMode="EventTime")
