"""Streams: rollouts as keyed state, late rows."""

from collections import OrderedDict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import harness, loops
from tessera.plans.programs import problems, scripted
from tessera.storage import shared_path
from tessera.streaming import events, rollouts

DATA = "/root/testdata/sf0.001"
START = "2026-01-01 00:0{}:00"


def streamed(spark, *files):
    """A stream of the rows of files, a file a batch, in order."""
    schema = "problem_id long, trajectory_id int, turn int, action string, ts timestamp"
    folder = shared_path(spark, "answers")
    for rows in files:
        spark.createDataFrame(rows, "problem_id long, trajectory_id int, turn int, action string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_rollouts_by_state(spark):
    p = problems(spark, DATA, 4)
    size = {r["problem_id"]: int(r["question"].split()[1]) for r in p.collect()}
    right = lambda k: f"```python\nclass Solution:\n    def solve(self, x):\n        return x + {size[k]}\nif __name__ == '__main__':\n    print(int(input()) + {size[k]})\n```"
    at = lambda m: START.format(m)
    look = "<interact>print(1)</interact>"
    first = [(1, 0, 1, look, at(1)), (2, 0, 2, right(2), at(2)), (3, 0, 1, right(3), at(1)), (0, 0, 1, look, at(1)), (9, 0, 1, look, at(1)), (1, 1, 1, None, at(1))]
    # the first turn of problem 2 comes after its second, an answer comes twice, with another text
    second = [(2, 0, 1, look, at(2)), (1, 0, 2, right(1), at(2)), (1, 0, 2, "nothing", at(2)), (3, 0, 2, "nothing", at(2)), (1, 1, 2, look, at(2))]
    third = [(3, 0, 3, look, at(3)), (1, 0, 3, look, at(3)), (1, 1, 3, right(1).replace("+", "-"), at(3))]
    later = [[(1, 7, 0, None, f"2026-01-0{day} 00:00:00")] for day in (2, 3)]
    out = events.drained(rollouts.ended_rollouts(streamed(spark, first, second, third, *later), p, 3), "ended", "append")
    got = {(r["problem_id"], r["trajectory_id"]): tuple(r)[2:] for r in out.collect()}
    assert got == {
        (1, 0): (2, 1.0, True, False, True, 0, 0, True),
        (2, 0): (2, 1.0, True, False, True, 0, 0, True),
        (3, 0): (3, 0.0, False, True, True, 0, 0, True),  # an answer too early, nothing, the last turn
        (0, 0): (1, 0.0, False, True, True, 0, 0, False),  # never answered again
        (1, 1): (3, 0.0, True, False, True, 0, 0, True),
    }


def test_rollouts_by_state_equal_the_batch(spark, tmp_path):
    p = problems(spark, DATA, 30)
    batch = loops.multi_turn(spark, p, str(tmp_path), scripted, 2, 3).drop("transcript")
    want = {tuple(r) for r in batch.withColumn("answered", F.lit(True)).select(*rollouts._NAMES).collect()}
    folder = shared_path(spark, "recorded")
    for turn in (1, 2, 3):
        told = spark.read.parquet(f"{tmp_path}/round={turn}-spoken")
        told.select("problem_id", "trajectory_id", F.lit(turn).alias("turn"), "action", F.lit(START.format(turn)).cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    answers = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    got = {tuple(r) for r in events.drained(rollouts.ended_rollouts(answers, p, 3), "ended", "append").collect()}
    assert got == want and len(got) == 60 and {r[3] for r in got} == {0.0, 1.0}


def test_rows_behind_the_watermark_are_dropped(spark):
    schema = "user_id long, event_type string, value double, ts timestamp"
    folder = shared_path(spark, "late")
    for rows in ([(1, "a", 1.0, "2026-01-10 00:00:00")], [(1, "a", 2.0, "2026-01-10 06:00:00")], [(2, "a", 4.0, "2026-01-01 00:00:00")], [(1, "a", 8.0, "2026-01-20 00:00:00")], [(2, "a", 16.0, "2026-01-19 13:00:00")]):
        spark.createDataFrame(rows, "user_id long, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    counts = events.window_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "1 day", late="1 day")
    got = {str(r["start"])[:10]: (r["n"], r["total"]) for r in events.drained(counts, "windows", "append").collect()}
    assert got == {"2026-01-10": (2, 3.0)}  # older than the watermark: gone; windows still open: not told yet
    upserted = events.drained(events.running_best(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), "best", "update", ["user_id"])
    assert {r["user_id"]: (r["n"], r["best"]) for r in upserted.collect()} == {1: (3, 8.0), 2: (2, 16.0)}


def test_update_mode_needs_a_key(spark):
    with pytest.raises(ValueError):
        events.drained(spark.range(1), "x", "update")


def test_equal_programs_of_a_task_share_a_run(tmp_path):
    notes = tmp_path / "notes"
    notes.touch()
    rollout = rollouts.Rollout(3, 5.0, 1000)
    rollout.child, rollout.results = harness.Child(), OrderedDict()
    code = f"open({str(notes)!r}, 'a').write('x')\nprint(input())"
    state = [1, True, 0, 0, False, 0, 0]
    with rollout.child:
        for given, reward in (("1", 1.0), ("1", 1.0), ("2", 0.0)):
            assert rollout._step(list(state), None, code, "execute", None, [given], ["1"]) == (reward, True, False)
    assert len(notes.read_text()) == 2


class Store:
    """A state store of one key, and a handle to it; counts its calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def _called(self, x=None):
        self.calls += 1
        return x

    getValueState = getMapState = lambda self, *_: self
    get = lambda self: self._called(self.value)
    update = lambda self, x: self._called(setattr(self, "value", x))
    getValue = lambda self, k: self._called(self.map[k])
    updateValue = lambda self, k, v: self._called(self.map.update({k: v}))
    removeKey = lambda self, k: self._called(self.map.pop(k))
    registerTimer = lambda self, t: self._called(self.timers.add(t))
    deleteTimer = lambda self, t: self._called(self.timers.remove(t))


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_batch_calls_the_store_once_a_bucket():
    store, rollout = Store(), rollouts.Rollout(3, 5.0, 1000)
    rollout.init(store)
    row = lambda p, s, turn, ms: {"problem_id": p, "trajectory_id": s, "turn": turn, "ms": ms, "interact_code": None, "code": "", "verdict": "no_code", "fn_name": None, "inputs": None, "outputs": None}
    batch = lambda rows, now: [r for f in rollout.handleInputRows((0,), iter([pd.DataFrame(rows)]), Time(now)) for r in f.itertuples(index=False, name=None)]
    # 500 rollouts of three useless answers, the others have one, and their next one waits for those with an even number
    many = [row(p, s, t, 5000 + p) for p in range(500) for s in range(2) for t in ((1, 2, 3) if s else (1,))]
    assert sorted(batch(many, 0)) == [(p, 1, 3, 0.0, False, True, False, 0, 0, True) for p in range(500)]
    assert store.calls <= 4 and store.timers == {6000}
    store.calls = 0
    assert batch([row(p, 1, 1, 9000) for p in range(500)], 0) == [] and store.calls == 1  # they are over
    assert batch([row(2, 0, 3, 5002)], 0) == [] and list(store.map) == [(2, 0, 3)]
    store.calls = 0
    timed = [r for f in rollout.handleExpiredTimer((0,), Time(6249), Time(6000)) for r in f.itertuples(index=False, name=None)]
    assert sorted(timed) == [(p, 0, 1, 0.0, False, True, False, 0, 0, False) for p in range(250)]
    assert store.calls <= 4 and not store.map and 6250 in store.timers
    assert batch([row(250, 0, 2, 5000), row(250, 0, 3, 5000)], 6249) == [(250, 0, 3, 0.0, False, True, False, 0, 0, True)]


def test_rollouts_of_one_bucket_end_by_themselves(spark):
    p = problems(spark, DATA, 4)
    look, at = "<interact>print(1)</interact>", lambda m: START.format(m)
    first = [(0, 0, 1, look, at(0)), (1, 0, 1, look, at(1)), (2, 0, 3, look, at(1)), (3, 0, 3, "nothing", at(1)), (3, 0, 2, look, at(1))]
    second = [(0, 0, 2, look, at(2)), (2, 0, 1, look, at(2)), (3, 0, 1, look, at(2)), (3, 0, 3, look, at(2))]
    third = [(0, 0, 3, look, at(3)), (3, 0, 1, look, at(3))]
    # a watermark between what the last two rollouts are due, then one beyond both
    later = [[(1, 7, 0, None, "2026-01-01 00:12:30")], [(1, 7, 0, None, "2026-01-01 00:13:30")], [(1, 7, 0, None, "2026-01-02 00:00:00")]]
    out = events.drained(rollouts.ended_rollouts(streamed(spark, first, second, third, *later), p, 3, buckets=1), "ended", "append")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [
        (0, 0, 3, 0.0, False, True, True, 0, 0, True),
        (1, 0, 1, 0.0, False, True, True, 0, 0, False),
        (2, 0, 1, 0.0, False, True, True, 0, 0, False),  # its third answer waited for the second
        (3, 0, 3, 0.0, False, True, True, 0, 0, True),
    ]
