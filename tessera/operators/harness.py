"""Running candidate programs against tests, in limited processes.

Each task of Spark has one child interpreter (``candidate``), which forks for every
program; the Python worker itself runs none of it, and no source is ever spliced.
A task's failure is retried by Spark.  Rows of the same program, with the same tests,
share one run, unless each is to have its own: only distinct programs travel to a run,
and the rows are joined with what it gave."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.candidate import outputs_match, results_match  # noqa: F401
from tessera.storage import cut

MEMORY = 10 << 30
#: Seconds of a program as a whole where its tests have no limit, and beyond theirs.
WHOLE, BEYOND = 60.0, 5.0

# Fixed value: what a snippet that takes too long is told.
TIMED_OUT = (
    "Execution timed out\n\nMaybe you are doing lots of operations?\nMaybe you are accepting inputs from stdin in interact blocks? "
    "(you need to hardcode inputs yourself when doing interactions)\n\nIf you are trying to submit the final answer, use only ```python``` blocks."
)


class Child:
    """The interpreter that runs programs; a new one takes the place of one that
    has gone."""

    def __init__(self):
        self.process = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process = None

    def _start(self):
        name = "tessera.operators.candidate"
        source = find_spec(name).loader.get_source(name)  # also from an archive
        env = {**os.environ, "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}
        self.process = subprocess.Popen([sys.executable, "-I", "-c", source], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=env)

    def lines(self, task: dict) -> Iterator[dict]:
        """What the child says of a task, until it says no more or has gone."""
        if self.process is None or self.process.poll() is not None:
            self._start()
        try:
            self.process.stdin.write(json.dumps(task) + "\n")
            self.process.stdin.flush()
            while line := self.process.stdout.readline():
                yield json.loads(line)
        except (BrokenPipeError, ValueError):  # it went in the middle of a line
            pass
        self.__exit__()

    def run(self, task: dict) -> dict | None:
        for _ in range(2):
            for answer in self.lines(task):
                return answer
        return None


def run_cases(child: Child, code: str, inputs: list, outputs: list, fn_name: str | None, seconds: float | None = 1.0, max_tests: int = 15) -> tuple[int, int, list[int]]:
    """(passed, total, indices of the late tests). The first tests are taken; a
    program that fails or overruns as a whole passes none and has no late test."""
    inputs, outputs = ([x or "" for x in v[:max_tests]] for v in (inputs, outputs))
    if not inputs or not outputs:
        return 0, len(inputs), []
    overall = seconds * len(inputs) + BEYOND if seconds and seconds > 0 else WHOLE
    got = child.run({"kind": "tests", "code": code, "inputs": inputs, "outputs": outputs, "fn_name": fn_name, "seconds": seconds, "memory": MEMORY, "overall": overall})
    if not isinstance(got, dict) or "passed" not in got:
        return 0, len(inputs), []
    return got["passed"], got["total"], got["late"]


def run_snippet(child: Child, code: str, seconds: float | None) -> tuple[bool, str, str]:
    """(ok, output, error) of a program by itself."""
    got = child.run({"kind": "snippet", "code": code, "memory": MEMORY, "overall": seconds or WHOLE})
    if got and "ok" in got:
        return got["ok"], got["stdout"], got["stderr"]
    return False, "", TIMED_OUT if got and got.get("timed_out") else ""


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key in a set number of tasks: by their few bytes alone, adaptive
    execution would run all their programs in one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def together(df: DataFrame, program: list[str]) -> DataFrame:
    """The same, but by program: rows of equal ones follow each other in a task."""
    name = F.xxhash64(*program)
    return dealt(df, [name]).sortWithinPartitions(name)


class Last:
    """What was made of the last arguments, made anew when others come."""

    def __init__(self, share: bool = True):
        self.share, self.of, self.made = share, None, None

    def get(self, of: tuple, make):
        if not self.share or self.of != of:
            self.made, self.of = make(), of
        return self.made


#: What a score adds to a row.
SCORE = ["final_reward", "n_passed", "n_tests", "n_timeouts", "late_tests"]
_RAN, _SAID = "passed long, total long, late array<int>", "ok boolean, stdout string, stderr string"

#: (child, row) to what a run gives
Run = Callable[[Child, dict], tuple]


def _each(df: DataFrame, ids: list[str], run: Run, made: str) -> DataFrame:
    """(ids, what *run* makes) of each row, by one child interpreter a task."""
    schema = StructType([*df.select(*ids).schema.fields, *StructType.fromDDL(made).fields])

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Child() as child:
            for f in frames:
                yield pd.DataFrame([[*(r[k] for k in ids), *run(child, r)] for r in f.to_dict("records")], columns=schema.fieldNames())

    return df.mapInPandas(runs, schema)


def shared(df: DataFrame, program: dict[str, Column], run: Run, made: str) -> DataFrame:
    """Adds to each row what *run* makes of its program, a struct __ran. Equal programs
    are run once, at once, and their results are written; rows find theirs by the 256
    bits of the program's name and stay where they are if Spark broadcasts the results,
    as it does few. *df* is read twice and has to give the same rows."""
    name = F.unhex(F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in program.items()])), 256))
    programs = df.select(name.alias("__program"), *[c.alias(k) for k, c in program.items()]).distinct()
    results = _each(dealt(programs, ["__program"]), ["__program"], run, made)
    results = cut(results.select("__program", F.struct(*StructType.fromDDL(made).fieldNames()).alias("__ran")), "results")
    return df.withColumn("__program", name).join(results, "__program").drop("__program")


def _tests(seconds: float | None, max_tests: int) -> Run:
    def run(child: Child, r: dict) -> tuple:
        inputs, outputs = ([] if r[c] is None else list(r[c]) for c in ("inputs", "outputs"))
        return run_cases(child, r["code"], inputs, outputs, r["fn_name"] or None, seconds, max_tests)

    return run


def _score(ran: Column, late_tests: int) -> dict[str, Column]:
    passed, total, late = ran["passed"], ran["total"], ran["late"]
    return dict(zip(SCORE, [F.when(total > 0, passed / total).otherwise(0.0), passed, total, F.size(late).cast("long"), F.slice(late, 1, late_tests)]))


def with_scores(df: DataFrame, seconds: float | None = 1.0, max_tests: int = 15, late_tests: int = 0) -> DataFrame:
    """Adds SCORE to rows with verdict, code, fn_name and tests, as *scored* does;
    equal programs with equal tests share a run (see *shared*)."""
    df = df.drop(*SCORE)
    program = {"code": F.col("code"), "fn_name": F.col("fn_name"), "inputs": F.col("tests.inputs"), "outputs": F.col("tests.outputs")}
    ran = shared(df.where("verdict = 'execute'"), program, _tests(seconds, max_tests), _RAN).withColumns(_score(F.col("__ran"), late_tests)).drop("__ran")
    zero = F.lit(0).cast("long")
    rest = df.where("verdict <> 'execute'").withColumns(dict(zip(SCORE, [F.lit(0.0), zero, zero, zero, F.array().cast("array<int>")])))
    return ran.unionByName(rest)


def scored(df: DataFrame, keys: list[str], seconds: float | None = 1.0, max_tests: int = 15, late_tests: int = 0, share: bool = True) -> DataFrame:
    """(keys, final_reward, n_passed, n_tests, n_timeouts, late_tests) of rows with
    verdict, code, fn_name and tests. Only rows to execute reach Python; the others
    have reward 0 at once. Programs are dealt out evenly, as their cost is in the run;
    equal ones with equal tests share a run, unless *share* is false (for programs
    whose runs differ). late_tests are the indices of the first late tests, as many as are asked for."""
    if share:
        return with_scores(df.select(*keys, "verdict", "code", "fn_name", "tests"), seconds, max_tests, late_tests).select(*keys, *SCORE)
    todo = df.where("verdict = 'execute'").select(*keys, "code", "fn_name", F.col("tests.inputs").alias("inputs"), F.col("tests.outputs").alias("outputs"))
    ran = _each(dealt(todo, keys), keys, _tests(seconds, max_tests), _RAN)
    made = _score(F.struct("passed", "total", "late"), late_tests)
    zero = F.lit(0).cast("long")
    rest = df.where("verdict <> 'execute'").select(*keys, F.lit(0.0).alias("final_reward"), zero.alias("n_passed"), zero.alias("n_tests"), zero.alias("n_timeouts"), F.array().cast("array<int>").alias("late_tests"))
    return ran.select(*keys, *[c.alias(k) for k, c in made.items()]).unionByName(rest)


def with_outputs(df: DataFrame, code: str = "interact_code", seconds: float | None = 5.0) -> DataFrame:
    """Adds ok, stdout and stderr of each row's snippet; equal ones share a run (see
    *shared*)."""
    ran = shared(df, {"code": F.col(code)}, lambda child, r: run_snippet(child, r["code"], seconds), _SAID)
    return ran.withColumns({k: F.col("__ran")[k] for k in ("ok", "stdout", "stderr")}).drop("__ran")


def interacted(df: DataFrame, keys: list[str], code: str = "interact_code", seconds: float | None = 5.0, share: bool = True) -> DataFrame:
    """(keys, ok, stdout, stderr) of each row's snippet; equal ones share a run,
    unless *share* is false."""
    snippets = df.select(*keys, code)
    if share:
        return with_outputs(snippets, code, seconds).select(*keys, "ok", "stdout", "stderr")
    return _each(dealt(snippets, keys), keys, lambda child, r: run_snippet(child, r[code], seconds), _SAID)
