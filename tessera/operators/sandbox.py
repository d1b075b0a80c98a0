"""Verdicts of single tests, as a table function.

Every test of a program runs in a process of its own, so many at a time in a task.
A verdict is true, false (wrong, failed or late) or null: nothing can be said, as
the sandbox, which is the child interpreter, went away under the test.  A program
none of whose tests has a verdict is tried again in a new sandbox; other errors are
final.  The function gives a row a test; means take the verdicts that there are.
Equal programs with equal tests that follow each other share their runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.harness import Child, Last, dealt, together

#: Processes of a task at a time, and sandboxes that a program is tried in.
PARALLEL, ATTEMPTS = 32, 3
SECONDS = 20.0
#: Bytes of address space of a test, within which a share of the executor's lies.
LEAST_MEMORY, MOST_MEMORY = 2 << 30, 10 << 30

RUN = "test int, verdict boolean, late boolean, milliseconds long, error string, attempts int"


def memory_share(spark: SparkSession) -> int:
    """A test's address space: an executor's memory by its cores, within bounds."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    text = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").strip().lower().removesuffix("b")
    scale = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1])
    size = int(text[:-1]) << scale if scale else int(text)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return min(max(size // max(cores, 1), LEAST_MEMORY), MOST_MEMORY)


class TestRuns:
    """The table function: a program's code, tests and limits to a row a test."""

    __test__ = False  # no test of the library's own
    share = True  # equal rows that follow each other are run once

    def __init__(self):
        self.child, self.last = Child(), Last(self.share)

    def eval(self, code: str, inputs: list, outputs: list, fn_name: str, seconds: float, max_tests: int, parallel: int, attempts: int, memory: int) -> Iterator[tuple]:
        given, wanted = ([x or "" for x in (v or [])[:max_tests]] for v in (inputs, outputs))
        n = min(len(given), len(wanted))
        if not n or code is None:
            return
        yield from self.last.get((code, given[:n], wanted[:n], fn_name or None, seconds, parallel, attempts, memory), lambda: self.runs(code, given[:n], wanted[:n], fn_name or None, seconds, parallel, attempts, memory))

    def runs(self, code: str, given: list, wanted: list, fn_name: str | None, seconds: float, parallel: int, attempts: int, memory: int) -> list[tuple]:
        """A row for each test."""
        task = {"kind": "cases", "code": code, "inputs": given, "outputs": wanted, "fn_name": fn_name, "seconds": seconds, "parallel": parallel, "memory": memory}
        for attempt in range(1, attempts + 1):
            found, error = {}, "sandbox"
            for said in self.child.lines(task):
                if "test" in said:
                    found[said["test"]] = said
                elif "error" in said:
                    error = said["error"]
                else:
                    break
            if error != "sandbox" or any(x["verdict"] is not None for x in found.values()):
                break
            self.terminate()  # the next attempt has a new one
        rows = [found.get(i, {"verdict": None, "late": False, "ms": None, "error": error}) for i in range(len(given))]
        return [(i, x["verdict"], x["late"], x["ms"], x["error"], attempt) for i, x in enumerate(rows)]

    def terminate(self):
        self.child.__exit__()


class EachRun(TestRuns):
    """The same, but every row has its own runs."""

    share = False


def register(spark: SparkSession, name: str = "test_runs") -> None:
    """Makes the function known to SQL: ``FROM programs, LATERAL test_runs(code,
    inputs, outputs, fn_name, seconds, max_tests, parallel, attempts, memory)``."""
    spark.udtf.register(name, F.udtf(TestRuns, returnType=RUN))


def test_runs(df: DataFrame, keys: list[str], seconds: float = SECONDS, max_tests: int = 15, parallel: int = PARALLEL, attempts: int = ATTEMPTS, memory: int | None = None, share: bool = True) -> DataFrame:
    """(keys, test, verdict, late, milliseconds, error, attempts) of rows with code
    and tests (inputs, outputs, fn_name), by a lateral join with the table function.

    The first *max_tests* tests are taken. Rows without code or tests have no row.
    error says why a verdict is null: ``sandbox`` (it went away, in *attempts* of
    them), ``fork: ...`` (no process could be made) or ``inputs`` (a function's
    arguments that aren't literals; never tried again). Programs are dealt out
    evenly, as their cost is in the run, whatever their size; equal ones with equal
    tests share their runs, milliseconds included, unless *share* is false."""
    memory = memory or memory_share(df.sparkSession)
    runs = F.udtf(TestRuns if share else EachRun, returnType=RUN)
    rows = df.select(*keys, "code", F.col("tests.inputs").alias("inputs"), F.col("tests.outputs").alias("outputs"), F.col("tests.fn_name").alias("fn_name"))
    rows = together(rows, ["code", "inputs", "outputs", "fn_name"]) if share else dealt(rows, keys)
    args = [F.col(c).outer() for c in ("code", "inputs", "outputs", "fn_name")]
    limits = [F.lit(float(seconds)), F.lit(max_tests), F.lit(parallel), F.lit(attempts), F.lit(memory).cast("long")]
    made = [x.split()[0] for x in RUN.split(", ")]
    return rows.lateralJoin(runs(*args, *limits)).select(*keys, *made)


test_runs.__test__ = False


def verdict_means(runs: DataFrame, keys: list[str], late_tests: int = 0) -> DataFrame:
    """(keys, n_tests, n_verdicts, n_passed, pass_rate, passed, n_late, late_tests,
    sandbox_error) from rows of tests: the rate is over verdicts that aren't null
    and 0 without any; sandbox_error marks programs that no sandbox outlived.
    late_tests has the first indices of late tests, as many as are asked for."""
    verdicts, passed = F.count("verdict"), F.count_if("verdict")
    late = F.array_sort(F.collect_list(F.when(F.col("late"), F.col("test"))))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_tests"),
        verdicts.alias("n_verdicts"),
        passed.alias("n_passed"),
        F.coalesce(F.try_divide(passed, verdicts), F.lit(0.0)).alias("pass_rate"),
        ((verdicts > 0) & (passed == verdicts)).alias("passed"),
        F.count_if("late").alias("n_late"),
        (F.slice(late, 1, late_tests) if late_tests else F.array().cast("array<int>")).alias("late_tests"),
        ((verdicts == 0) & F.bool_or(F.col("error").isNotNull() & (F.col("error") != "inputs"))).alias("sandbox_error"),
    )


def late_report(means: DataFrame) -> DataFrame:
    """(n_programs, n_tests, n_late, late_rate, programs_late) over all programs."""
    late, tests = F.sum("n_late"), F.sum("n_tests")
    return means.agg(F.count("*").alias("n_programs"), tests.alias("n_tests"), late.alias("n_late"), F.coalesce(F.try_divide(late, tests), F.lit(0.0)).alias("late_rate"), F.count_if(F.col("n_late") > 0).alias("programs_late"))
