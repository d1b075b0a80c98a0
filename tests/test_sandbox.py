"""Verdicts of single tests: right, wrong, late, and none where the sandbox goes."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import harness, sandbox
from tessera.schemas import TESTS

LIMITS = (1.0, 15, 4, 3, 8 << 30)


def verdicts(code, inputs, outputs, fn_name=None, limits=LIMITS):
    runs = sandbox.TestRuns()
    try:
        return list(runs.eval(code, inputs, outputs, fn_name, *limits))
    finally:
        runs.terminate()


@pytest.mark.parametrize(
    "code, fn_name, given, want, verdict",
    [
        ("print(int(input()) * 2)", None, "4", "8", True),
        ("print(' 8.0004 ')", None, "", "8\n", True),
        ("print('True')", None, "", "true", False),  # the case of a boolean counts here
        ("print(8)\nraise SystemExit(3)", None, "", "8", False),
        ("print(8)\nraise SystemExit", None, "", "8", True),
        ("print(8)\n1 / 0", None, "", "8", False),
        ("import os\nos.write(1, b'8')\nos._exit(0)", None, "", "8", True),
        ("import os, signal\nprint(8, flush=True)\nos.kill(os.getpid(), signal.SIGKILL)", None, "", "8", False),
        ("x = (", None, "", "", False),
        ("import sys\nprint(sys.stdin.read().split()[-1])", None, "a\nb\nc", "c", True),
        ("x = bytearray(20 << 30)\nprint(8)", None, "", "8", False),
        ("def f(a, b): return (a, b)", "f", "1\n[2]", "[1, [2]]", True),
        ("class Solution:\n    def f(self, a): return {1: a}", "f", "2", '{"1": 2}', True),
        ("def f(a): return 5", "f", "1", "[5, 6]", True),
        ("def f(a): return {a}", "f", "1", "[1]", False),
        ("print('noise')\ndef f(a): return 5", "f", "1", "5", False),
        ("def g(a): return 5", "f", "1", "5", False),
        ("def f(a): return 5", "f", "1", "not json", False),
    ],
)
def test_one_verdict(code, fn_name, given, want, verdict):
    rows = verdicts(code, [given], [want], fn_name)
    assert [r[:3] for r in rows] == [(0, verdict, False)] and rows[0][4] is None and rows[0][5] == 1


def test_late_is_false_and_tests_run_side_by_side():
    began = time.time()
    rows = verdicts("import time\nif input() == 'x': time.sleep(60)\nprint(1)", ["x"] * 4 + ["y"], ["1"] * 5, limits=(1.5, 15, 5, 3, 8 << 30))
    assert [(r[1], r[2]) for r in rows] == [(False, True)] * 4 + [(True, False)]
    assert all(r[3] >= 1500 for r in rows[:4]) and time.time() - began < 15


def test_a_sandbox_that_goes_gives_null():
    rows = verdicts("import os\nos.kill(os.getppid(), 9)", ["", ""], ["", ""])
    assert rows == [(i, None, False, None, "sandbox", 3) for i in range(2)]
    partly = verdicts("import os, time\nif input() == 'x':\n    time.sleep(0.7)\n    os.kill(os.getppid(), 9)\nprint(1)", ["a", "x"], ["1", "1"])
    assert [r[1] for r in partly] == [True, None] and partly[1][4] == "sandbox" and partly[1][5] == 1


def test_arguments_that_are_no_literals_are_final():
    assert verdicts("def f(a): return a", ["1", "__import__('os')"], ["1", "2"], "f") == [(i, None, False, None, "inputs", 1) for i in range(2)]


def test_output_beyond_the_limit_and_closed_output_end():
    rows = verdicts("import os, time\nos.close(1)\ntime.sleep(60)", [""], [""])
    assert rows[0][1:3] == (False, True)
    assert verdicts("while True: print('x' * 10**6)", [""], ["x"])[0][1] is False


def test_runs_and_means_of_a_table(spark):
    rows = [
        (1, "import sys\nprint(sys.stdin.read())", ["a", "b", None], ["a", "x", ""], None),
        (2, None, ["a"], ["a"], None),
        (3, "print(1)", [], [], None),
        (4, "import os\nos.kill(os.getppid(), 9)", ["a"], ["a"], None),
        (5, "def f(x): return x", ["1", "open('x')"], ["1", "2"], "f"),
        (6, "print(1)", ["a"] * 20, ["1"] * 20, ""),
    ]
    df = spark.createDataFrame(rows, "k long, code string, i array<string>, o array<string>, fn string")
    df = df.withColumn("tests", F.struct(F.col("i").alias("inputs"), F.col("o").alias("outputs"), F.col("fn").alias("fn_name")).cast(TESTS))
    runs = sandbox.test_runs(df, ["k"], 5.0).cache()
    means = {r["k"]: r for r in sandbox.verdict_means(runs, ["k"], 3).collect()}
    assert sorted(means) == [1, 4, 5, 6]
    assert (means[1]["n_tests"], means[1]["n_passed"]) == (3, 2) and abs(means[1]["pass_rate"] - 2 / 3) < 1e-12
    assert means[4]["sandbox_error"] and means[4]["pass_rate"] == 0 and not means[4]["passed"]
    assert not means[5]["sandbox_error"] and means[5]["n_verdicts"] == 0
    assert means[6]["n_tests"] == 15 and means[6]["passed"]
    assert sandbox.late_report(sandbox.verdict_means(runs, ["k"])).first()["n_late"] == 0
    assert sandbox.test_runs(df.where("false"), ["k"]).count() == 0


def test_sql_form(spark):
    sandbox.register(spark, "test_runs")
    got = spark.sql("SELECT k, r.test, r.verdict FROM VALUES (1, 'print(1)'), (2, 'print(2)') AS t(k, code), LATERAL test_runs(code, array('', ''), array('1', '2'), '', 5D, 15, 2, 3, 8589934592L) AS r")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, True), (1, 1, False), (2, 0, False), (2, 1, True)]


def test_memory_is_a_share_of_the_executor(spark):
    assert sandbox.LEAST_MEMORY <= sandbox.memory_share(spark) <= sandbox.MOST_MEMORY


@pytest.fixture
def counted(tmp_path):
    """(a program that notes each of its runs, what gives their number)."""
    notes = tmp_path / "notes"
    notes.touch()
    return f"open({str(notes)!r}, 'a').write('x')\nprint(1)", lambda: len(notes.read_text())


@pytest.mark.parametrize("share, runs", [(True, 1), (False, 6)])
def test_equal_programs_share_a_run(spark, counted, share, runs):
    code, noted = counted
    df = spark.range(6, numPartitions=3).select("id", F.lit(code).alias("code"), F.lit(code).alias("interact_code"), F.lit("execute").alias("verdict"), F.lit(None).cast("string").alias("fn_name"))
    df = df.withColumn("tests", F.struct(F.array(F.lit("")).alias("inputs"), F.array(F.lit("1")).alias("outputs"), "fn_name").cast(TESTS))
    assert {(r["id"], r["final_reward"]) for r in harness.scored(df, ["id"], share=share).collect()} == {(i, 1.0) for i in range(6)}
    assert noted() == runs
    assert {(r["id"], r["stdout"]) for r in harness.interacted(df, ["id"], share=share).collect()} == {(i, "1\n") for i in range(6)}
    assert noted() == 2 * runs
    assert {(r["id"], r["verdict"]) for r in sandbox.test_runs(df, ["id"], 5.0, share=share).collect()} == {(i, True) for i in range(6)}
    assert noted() == 3 * runs


def test_other_tests_have_runs_of_their_own(spark, counted):
    code, noted = counted
    df = spark.range(4).select("id", F.lit(code).alias("code"), F.lit("execute").alias("verdict"), F.lit(None).cast("string").alias("fn_name"))
    df = df.withColumn("tests", F.struct(F.array(F.lit("")).alias("inputs"), F.array((F.col("id") % 2).cast("string")).alias("outputs"), "fn_name").cast(TESTS))
    assert {(r["id"], r["n_passed"]) for r in harness.scored(df, ["id"]).collect()} == {(i, i % 2) for i in range(4)}
    assert {(r["id"], r["verdict"]) for r in sandbox.test_runs(df, ["id"], 5.0).collect()} == {(i, i % 2 == 1) for i in range(4)}
    assert noted() == 4


def test_array_libraries_are_loaded_for_programs_that_name_them():
    with harness.Child() as child:
        shown = lambda code: harness.run_snippet(child, code, 20.0)[:2]
        assert shown("import sys\nprint('num' + 'py' in sys.modules)") == (True, "False\n")
        assert shown("print(globals()['n' + 'p'].arange(3).sum())") == (True, "3\n")
        assert shown("print(np.arange(3).sum(), pd.Series([1, 2]).sum())") == (True, "3 3\n")
        assert shown("from numpy import arange\nprint(len(arange(4)))") == (True, "4\n")


def test_rows_of_one_program_stay_spread(spark):
    df = spark.range(400, numPartitions=4).select("id", F.lit("print(1)").alias("code"), F.lit("print(1)").alias("interact_code"), F.lit("execute").alias("verdict"), F.lit(None).cast("string").alias("fn_name"))
    df = df.withColumn("tests", F.struct(F.array(F.lit("")).alias("inputs"), F.array(F.lit("1")).alias("outputs"), "fn_name").cast(TESTS))
    for out in (harness.scored(df, ["id"]), harness.interacted(df, ["id"])):
        assert out.select(F.spark_partition_id()).distinct().count() == 4 and out.count() == 400
