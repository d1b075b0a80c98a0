"""Edge rules, one small table each."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import nested, text
from tessera.operators import datasets, environment, harness, loops, prefix, problems, scores, turns
from tessera.plans import programs
from tessera.schemas import MESSAGES, TESTS, normalised
from tessera.sources import tables


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def rewards(spark, lists):
    rows = [(p, i, float(r)) for p, rs in enumerate(lists) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "problem_id long, trajectory_id long, final_reward double")


def test_curve_counts_only_problems_with_k_samples(spark):
    got = {r["k"]: (r["n_problems"], r["best_at_k"], r["pass_at_k"], r["mean_at_k"]) for r in prefix.prefix_curve(rewards(spark, [[0, 1, 0.5], [0.2]])).collect()}
    assert got == {1: (2, 0.1, 0.0, 0.1), 2: (1, 1.0, 1.0, 0.5), 3: (1, 1.0, 1.0, 0.5)}


def test_pass_at_counts_all_problems(spark):
    got = {r["k"]: r["pass_at_k"] for r in prefix.pass_at(rewards(spark, [[0, 1], [0]]), [1, 2, 8]).collect()}
    assert got == {1: 0.0, 2: 0.5, 8: 0.5}
    assert prefix.pass_at(rewards(spark, []), [1]).collect() == []
    assert prefix.prefix_curve(rewards(spark, [])).collect() == []


def test_three_senses_of_success(spark):
    df = rewards(spark, [[0.5], [1.0], [0.0]]).withColumn("is_successful", F.col("problem_id") == 2)
    counts = [prefix.run_summary(df, s).first()["n_success"] for s in (prefix.FULL, prefix.PARTIAL, prefix.FLAGGED)]
    assert counts == [1, 2, 3]
    assert prefix.run_summary(df.limit(0)).first()["success_rate"] == 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([0.0, 0.3, 1.0]), min_size=5, max_size=5), min_size=1, max_size=4))
def test_curve_is_monotone_on_fixed_problems(spark, lists):
    rows = sorted(prefix.prefix_curve(rewards(spark, lists)).collect(), key=lambda r: r["k"])
    for a, b in zip(rows, rows[1:]):
        assert a["best_at_k"] <= b["best_at_k"] and a["pass_at_k"] <= b["pass_at_k"]
    assert all(r["success_at_k"] <= r["pass_at_k"] <= 1 and r["mean_at_k"] <= r["best_at_k"] for r in rows)


def test_ladder_clamps_from_eight_on():
    assert prefix.ladder(10, 32) == [1, 2, 4, 8, 10]
    assert prefix.ladder(3, 8) == [1, 2, 3, 4]


def test_merge_offsets():
    assert datasets.merge_offsets(["a", "b_100_200", "c", "d"], [5, 7, 3, 4], [None, None, None, 50]) == [0, 100, 107, 50]


def test_merge_keeps_rows_and_trajectory_ids(spark):
    a, b = rewards(spark, [[1], [0, 1]]), rewards(spark, [[0]]).withColumn("extra", F.lit("x"))
    got = datasets.merged([("a", a), ("b", b)]).orderBy("problem_id", "trajectory_id").collect()
    assert [(r["problem_id"], r["original_problem_id"], r["trajectory_id"], r["extra"]) for r in got] == [(0, 0, 0, None), (1, 1, 0, None), (1, 1, 1, None), (2, 0, 0, "x")]


def test_union_bounds_reach_the_files(spark, tmp_path):
    rewards(spark, [[1], [0], [1]]).write.parquet(str(tmp_path / "t"))
    df = tables.union_with_offsets([(spark.read.parquet(str(tmp_path / "t")), 10)], 11, 12)
    assert [r["problem_id"] for r in df.collect()] == [11]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(problem_id,2)" in plan
    frames, warnings = tables.readable(spark, [str(tmp_path / "t"), str(tmp_path / "none")])
    assert len(frames) == 1 and len(warnings) == 1


def test_files(spark, tmp_path):
    (tmp_path / "kv").write_text("# c\na\t1\nb\nc\t2\t3\n")
    assert [tuple(r) for r in tables.key_values(spark, str(tmp_path / "kv")).collect()] == [("a", "1")]
    (tmp_path / "gpu").write_text("0, 3, [N/A]\n1, 50, 700\n")
    rows = tables.device_rows(spark, str(tmp_path / "gpu"))
    assert tuple(problems.idle_devices(rows).first()) == (False, 1)
    assert tables.split_of("train-x") == "train" and tables.split_of("my-lcb-y") == "test" and tables.split_of("z") == "code"
    tables.save_metadata(spark, str(tmp_path / "m"), a=1)
    assert tables.load_metadata(spark, str(tmp_path / "m")) == {"a": 1}
    df = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    tables.write_key_values(df, str(tmp_path / "kv2"))
    assert tables.key_values(spark, str(tmp_path / "kv2")).count() == 2


def test_hardest_needs_samples_and_breaks_ties_by_id(spark):
    df = rewards(spark, [[0, 1], [0, 0], [0, 0], [0]])
    assert [(r["problem_id"], r["rank"]) for r in datasets.hardest(df, 2).orderBy("rank").collect()] == [(1, 0), (2, 1), (0, 2)]
    with pytest.raises(AssertionError):
        datasets.assert_hard(datasets.hardest(df, 2), 3)


def test_ranges(spark):
    df = spark.createDataFrame([(None,), (0.1,), (0.3,), (0.31,)], "s double")
    assert df.where(datasets.in_closed_range(F.col("s"), 0.1, 0.3)).count() == 2
    assert df.where(datasets.in_closed_range(F.col("s"), 0.0, 0.3, 0.0)).count() == 3
    for t, ok in (("2025-02-01T10:20:30.5Z", True), ("2025-02-01 10:20", True), ("2025-02-01", True), ("2025", False)):
        assert (one(spark, datasets.contest_date(F.col("t")), t=t) is not None) == ok
    with pytest.raises(LookupError):
        datasets.exactly_one(df, F.col("s") > 0)


def test_interact_extraction_differs_between_readers(spark):
    for x, evaluator, environment in (
        ("<interact>a<interact>b</interact>", "a<interact>b", "b"),
        ("<interact>a</interact> <interact>b", "a", None),
        ("<INTERACT>```python\nx\n```</interact>", "x", "x"),
        ("<interact></interact>", "", ""),
        ("none", None, None),
    ):
        assert one(spark, text.interact_last_pair("t"), t=x) == evaluator
        assert one(spark, text.interact_last_open("t"), t=x) == environment


def test_fences(spark):
    for x, want in (("```\na\n```\n```py\n b \n```", "b"), ("no", ""), ("```c++\nint x;\n```\nafter", "")):
        assert one(spark, text.last_fence("t"), t=x) == want
    assert one(spark, text.close_interact("t"), t="<interact>x") == "<interact>x</interact>"
    assert one(spark, text.close_interact("t"), t="<INTERACT>x") == "<INTERACT>x"


def test_classification_order(spark):
    rows = [("<interact>x</interact>```\na\n```", None), ("<interact></interact>", None), ("```\nx\n```", "f"), ("```\nclass Solution: pass\n```", "f"), ("```\nx\n```", None)]
    got = scores.classified(spark.createDataFrame(rows, "response string, fn_name string")).collect()
    assert [r["verdict"] for r in got] == ["interact", "no_code", "no_class", "execute", "execute"]
    assert [r["invalidated"] for r in got] == [False, False, True, False, False]


def test_text_helpers(spark):
    assert one(spark, text.tail_tokens("t", 2), t="a b c") == "Output too long, showing only last 2 tokens.\nb c"
    assert one(spark, text.tail_tokens("t", 0), t="a b c") == "a b c"
    assert one(spark, text.tail_in_frame("t", 1), t="<output>\na b</output>\n").endswith("b</output>")
    assert one(spark, text.tail_in_frame("t", 1), t="a b") == "a b"
    assert one(spark, text.unquoted("t"), t=' "a" ') == "a"
    assert one(spark, text.after_think("t"), t="<think>x") == ""
    assert one(spark, text.after_think("t"), t="<think>x</think> y") == "y"
    assert one(spark, text.fenced("t"), t="x") == "```python\nx\n```"
    assert one(spark, text.listed_numbers("t"), t="3, ,1") == [1, 3]
    assert one(spark, text.framed_output("o", "e", F.lit(True)), o=" ", e="") == "<output>\n </output>"
    assert one(spark, text.framed_output("o", "e", F.lit(True)), o="", e="") == f"<output>\n{text.NO_OUTPUT}</output>"
    assert one(spark, text.framed_output("o", "e", F.lit(False)), o="", e="") == "<output>\nError: execution failed.</output>"
    assert one(spark, text.framed_output("o", "e", F.lit(False)), o="x", e="bad") == "<output>\nError:\nbad</output>"
    assert one(spark, text.backoff(F.lit(0.5), F.lit(3)), t="") == 4.0
    assert one(spark, text.strip("t"), t="\u2003 a " + " " * 5000 + "b \n") == "a " + " " * 5000 + "b"
    assert one(spark, text.strip("t"), t=" \t ") == ""
    assert one(spark, text.timed_out("e"), e="it Timed Out") is True


def test_verifiers(spark):
    assert one(spark, text.sentence_count("t"), t="A. B!? ") == 2
    assert one(spark, text.word_count("t"), t=" a b\tc ") == 3
    assert one(spark, text.keyword_count("t", ""), t="abc") == 4
    assert one(spark, text.keyword_count("t", "a.B"), t="A.b axb") == 1
    told = lambda x: F.from_json(F.lit(x), "map<string,string>") if x else F.lit(None).cast("map<string,string>")
    words, sentences, seen = "length_constraints:number_words", "length_constraints:number_sentences", "keywords:frequency"
    for name, settings, want in (
        ("what", "{}", 0.5),
        (words, '{"relation": "around", "num_words": "1"}', 0.0),
        (words, "{}", 0.0),
        (words, '{"num_words": "2"}', 1.0),
        (words, '{"num_words": null}', 0.5),
        (words, '{"relation": null}', 0.0),
        (words, None, 0.5),
        (sentences, '{"relation": "less than"}', 1.0),
        (seen, "{}", 1.0),
        (seen, '{"keyword": "A", "frequency": "2"}', 0.0),
        (seen, '{"keyword": null}', 0.5),
        ("punctuation:no_comma", None, 1.0),
    ):
        assert one(spark, text.instruction_score("t", F.lit(name), told(settings)), t="a b") == want, (name, settings)
    reward = lambda names, n: text.instruction_reward("t", F.array(*map(F.lit, names)).cast("array<string>"), F.array(*[told("{}")] * n).cast("array<map<string,string>>"))
    assert one(spark, reward([], 0), t="x") == 1.0
    assert one(spark, reward(["punctuation:no_comma"] * 2, 1), t="x") == 0.5


def test_match_tiers(spark):
    for a, b, want in (("x ", "x", "trimmed"), ("a \nb", "a\n b", "lines"), ("a  b", "a b", "tokens"), ("a\n\n b", "a\nb", "lines"), ("a\nb", "a b", None), ("1", "2", None)):
        assert one(spark, text.match_tier("a", "b"), a=a, b=b) == want


def test_json(spark):
    assert one(spark, nested.parsed("t", "a int")["a"], t="{bad") is None
    assert [tuple(one(spark, nested.parsed_or_raw("t", "array<int>"), t=t)) for t in ("[1]", "{bad")] == [([1], None), (None, "{bad")]
    assert one(spark, nested.mean_of_nested(F.array(F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.5)))), t="") == 0.5
    assert one(spark, nested.parsed("t", "array<int>", "empty", F.array().cast("array<int>")), t="bad") == []
    assert one(spark, nested.integer_keys("t"), t='[{"1": 2}]') == "[{1: 2}]"
    assert one(spark, nested.integer_keys("t"), t="[1]") == "[1]"
    assert one(spark, nested.literals("t"), t="[1, 2]\nopen('x')") == ["[1, 2]", None]
    assert one(spark, nested.without_main("t"), t='a\nif __name__ == "__main__":\n  b\n\n  c\nd') == "a\nd"
    df = normalised(spark.createDataFrame([(1, '[{"role":"user","content":{"a":1}}]')], "problem_index long, messages string"))
    assert df.columns == ["problem_id", "messages"] and df.first()["messages"][0]["content"] == '{"a":1}'


def test_turns(spark):
    m = [("system", "s"), ("user", "u"), ("assistant", "a1"), ("user", "o"), ("assistant", "a2")]
    df = spark.createDataFrame([(1, m, 3, 1.0)], f"conv_id long, messages {MESSAGES}, num_turns long, final_reward double").withColumn("problem_id", F.lit(1))
    assert df.select(turns.last_assistant().alias("x")).first()["x"] == "a2"
    assert df.select(F.size(turns.first_turns("messages", 1)).alias("x")).first()["x"] == 4
    got = {r["requested_turn"]: r["already_complete"] for r in turns.early_termination(df.unionByName(df.withColumn("num_turns", F.lit(None).cast("long"))), [2, 3, 4]).collect()}
    assert got == {2: 0, 3: 1, 4: 1}
    with pytest.raises(ValueError):
        turns.early_termination(df, [0])
    assert df.select(turns.aggregation_prompt(F.lit("q"), F.array(F.lit("c"))).alias("x")).first()["x"] == f"{turns.REFINE_HEAD}q{turns.REFINE_MIDDLE}c{turns.REFINE_TAIL}"


@pytest.mark.parametrize("n,p10,p99", [(9, 0.0, 0.0), (10, 1.0, 0.0), (99, 9.0, 0.0), (100, 10.0, 99.0)])
def test_percentiles_by_index(spark, n, p10, p99):
    df = spark.createDataFrame([("a", float(i)) for i in range(n)], "m string, v double")
    r = scores.latency(df, "v", ["m"]).first()
    assert (r["p10"], r["p99"]) == (p10, p99)
    assert scores.latency(df.limit(1), "v", ["m"]).first()["stdev"] == 0.0


def test_losses(spark):
    r = rewards(spark, [[1.0]])
    assert scores.batch_advantages(r).first()["advantage"] is None
    x = spark.range(1).select(scores.masked_mean(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("x"), scores.padded(F.array(F.lit(1)), F.lit(3)).alias("p"), scores.completion_mask(F.lit(3), F.lit(2)).alias("m")).first()
    assert (x["x"], x["p"], x["m"]) == (0.0, [1, 0, 0], [0.0, 0.0, 1.0])


@pytest.mark.parametrize("a,b,same", [("1.0001", "1.0", True), ("1.1", "1", False), ("True", "true", True), ("nan", "nan ", True), ("nan 1", "nan 2", False), ("a\n\nb", "a\n b ", True), ("a\nb", "a b", False), ('"x"', "x", True), ("1 2", "1\n2.0001", True), ("", "x", False), ("1e1", "10", True)])
def test_outputs_match(a, b, same):
    assert harness.outputs_match(a, b) == same


@pytest.mark.parametrize(
    "want,value,same",
    [("0.5", 0.5004, False), ("abc", "abc", True), ("[3]", 3, True), ("[[1, 2]]", (1, 2), True), ("[[1, 2]]", [(1, 2)], True), ("[1, 2]", (1, 2), True), ("1", 1.0, True), ("None", None, True), ("null", None, True)],
)
def test_results_match(want, value, same):
    assert harness.results_match(want, value) == same


def test_harness():
    good = "class Solution:\n    def f(self, x: List[int], y):\n        return [x, y]"
    fresh = "class Solution:\n    def __init__(self):\n        self.n = 0\n    def f(self, x):\n        self.n += 1\n        return self.n"
    with harness.Child() as child:
        run = lambda *a: harness.run_cases(child, *a)
        assert run(good, ["1\n2"], ["[[1, 2]]"], "f", 1)[0] == 1
        assert run(fresh, ["1", "1"], ["1", "1"], "f", 1)[0] == 2
        assert run("print(int(input()) + 1)", ["1", "2"], ["2", "9"], None, 1) == (1, 2, [])
        assert run("print(gcd(4, 6))", [""], ["2"], None, 1)[0] == 1
        assert run("def f(x): return x", ["'a'"], ["a"], "f", 1)[0] == 1
        assert run("import sys; print(sys.stdin.read())", ["7"], ["7"], "f", 1)[0] == 1  # no such function: a script
        assert run("while True: pass", ["1"], ["2"], None, 0.2) == (0, 1, [0])
        assert run("import os; os._exit(3)", ["1"], ["2"], None, 0.2) == (0, 1, [])
        assert run("print(1); exit()", ["1"], ["1"], None, 0.2)[0] == 1
        assert run("def f(x): exit()", ["1"], ["1"], "f", 0.2)[0] == 0
        assert run("import os, signal; os.kill(os.getpid(), signal.SIGKILL)", ["1"], ["2"], None, 0.2) == (0, 1, [])
        assert run("x", [], [], None, 1) == (0, 0, [])
        assert run(good, ["bad(", "1\n2"], ["1", "[[1, 2]]"], "f", 1)[:2] == (1, 2)
        ok, out, err = harness.run_snippet(child, "import time; time.sleep(9)", 0.3)
        assert not ok and "timed out" in err
        assert harness.run_snippet(child, "print(1)\n1 / 0", 1)[:2] == (False, "1\n")


def test_environment(spark, tmp_path):
    """Interacts first; warned, told and cut short at the last turn; scored once."""
    says = ["```python\nprint(int(input()))\n```", "nothing", "<interact>print(3)</interact>", "```python\nprint(int(input()))\n```"]
    tests = spark.createDataFrame([(1, "q", None, (["4"], ["4"], None))], f"problem_id long, question string, fn_name string, tests {TESTS}")

    def speak(prompts, seeds):
        return prompts.map(lambda p: says[p.count("<output>")])

    r = loops.multi_turn(spark, tests, str(tmp_path / "a"), speak, 1, 5).first()
    assert (r["n_turns"], r["final_reward"], r["terminated"], r["truncated"]) == (4, 1.0, True, False)
    assert environment.MUST_INTERACT in r["transcript"] and environment.INVALID_FIRST in r["transcript"] and "<output>\n3\n</output>" in r["transcript"]
    r = loops.multi_turn(spark, tests, str(tmp_path / "b"), speak, 1, 2).first()
    assert (r["n_turns"], r["final_reward"], r["terminated"], r["truncated"]) == (2, 0.0, False, True)
    r = loops.multi_turn(spark, tests, str(tmp_path / "c"), lambda p, s: p.map(lambda _: says[0]), 1, 1).first()
    assert (r["terminated"], r["truncated"], r["has_interacted"]) == (False, True, False)


def test_catalog_and_bundles(spark):
    c = tables.Catalog("/x/", {"easy": "set_easy"})
    assert c.path("easy") == "/x/set_easy" and c.path("easy", "3") == "/x/set_easy@3"
    with pytest.raises(KeyError):
        c.path("hard")
    files = spark.createDataFrame([("a", "x"), ("b", "")], "path string, text string")
    tables.check_bundle(files.where("path = 'a'"))
    with pytest.raises(ValueError):
        tables.check_bundle(files)
    with pytest.raises(RuntimeError):
        datasets.reassembled(spark.range(3), spark.range(2), "id")


def test_scoring_keeps_every_row(spark):
    rows = [(1, "execute", "print(1)", None, (["a"], ["1"], None)), (2, "no_code", "", None, None)]
    df = spark.createDataFrame(rows, f"problem_id long, verdict string, code string, fn_name string, tests {TESTS}")
    assert {r["problem_id"]: r["final_reward"] for r in harness.scored(df, ["problem_id"]).collect()} == {1: 1.0, 2: 0.0}


def test_drift(spark, tmp_path):
    a = loops.Rounds(spark, str(tmp_path), model="x", num_samples=2)
    a.table("p", lambda: spark.range(3))
    assert a.done("p") and not a.done("q")
    assert loops.Rounds(spark, str(tmp_path), model="y", num_samples=2).drift("p") == ["model: x then, y now"]
    assert a.table("p", lambda: spark.range(9)).count() == 3


def test_lineage_and_subsets(spark):
    df = spark.range(3).select(datasets.seeded_subset(F.array(*map(F.lit, range(10))), 4, F.lit(1), F.col("id")).alias("s"))
    a, b = [[r["s"] for r in df.collect()] for _ in range(2)]
    assert a == b and all(len(set(x)) == 4 for x in a) and len({tuple(x) for x in a}) > 1
    assert json.dumps(programs.problems(spark, "/root/testdata/sf0.001", 2).first()["tests"]["inputs"])


def test_dates_as_one_program_cuts_them(spark):
    for t, ok in (("2025-02-01 10:20:30", False), ("2025-2-1", True), ("2025-2-1 1:2:3", True)):
        assert (one(spark, datasets.contest_date(F.col("t"), literal=True), t=t) is not None) == ok


def test_problem_sources(spark):
    tests = json.dumps({"inputs": [str(i) for i in range(20)], "outputs": [str(i) for i in range(20)], "fn_name": "f"})
    rows = spark.createDataFrame([("b", "Q1", tests, ["x"]), ("a", "Q2", "bad", ["```python\ny\n```"])], "k string, problem string, tests string, solutions array<string>")
    got = problems.training_problems(rows, "taco", "k").orderBy("info.subset_idx").collect()
    assert [r["answer"] for r in got] == ["```python\ny\n```", "```python\nx\n```"]
    few = got[1]["info"]["tests"]
    assert few["inputs"] == few["outputs"] and len(set(few["inputs"])) == 15 and few["fn_name"] == "f" and got[0]["info"]["tests"]["inputs"] is None
    cases = json.dumps([{"input": "1", "output": "2", "testtype": "functional"}])
    lcb = spark.createDataFrame([("a", "Q", cases, ("g",))], "k string, problem string, tests string, metadata struct<func_name:string>")
    assert problems.training_problems(lcb, "lcbv5", "k").first()["info"]["fn_name"] == "g"
    fares = spark.createDataFrame([("a", "Q", json.dumps({"tests": tests, "source": "s"}))], "k string, question string, info string")
    r = problems.training_problems(fares, "fares", "k").first()
    assert (r["info"]["source"], r["info"]["subset"], r["prompt"][0]["content"]) == ("s", "i3-code", "Q")
    contest = spark.createDataFrame([("Q", "", cases, "eJx", "{}"), ("Q", "def f", cases, cases, '{"func_name": "h"}')], "question_content string, starter_code string, public_test_cases string, private_test_cases string, metadata string")
    a, b = problems.benchmark_problems(contest, "t").collect()
    assert a["refused"] and len(a["info"]["tests"]["inputs"]) == 1 and "stdin" in a["question"]
    assert not b["refused"] and len(b["info"]["tests"]["inputs"]) == 2 and b["info"]["tests"]["fn_name"] == "h" and "starter" in b["question"]


def test_reevaluation(spark):
    schema = f"problem_id long, messages {MESSAGES}, tests {TESTS}"
    answer = "```python\nprint(1)\n```"
    active = spark.createDataFrame([(1, [("assistant", answer)], (["x"], ["1"], None)), (2, [("user", "hi")], None)], schema)
    done = spark.createDataFrame([(3, [], None, 0.5, True, False)], schema + ", final_reward double, terminated boolean, truncated boolean")
    got = {r["problem_id"]: (r["final_reward"], r["truncated"], r["from_active"]) for r in loops.reevaluated(done, active, ["problem_id"]).collect()}
    assert got == {1: (1.0, True, True), 3: (0.5, False, False)}


def test_budget_counts_extensions(spark, tmp_path):
    df = spark.createDataFrame([(1, "q")], "problem_id long, question string")
    r = loops.budget_forced(spark, df, str(tmp_path), lambda p, s: p.map(lambda x: "a b c"), 3, 4, shared_budget=True).first()
    assert (r["num_extensions"], r["total_tokens"], r["response"]) == (2, 4, "a b c Waita Wait")


def test_positions_of_many_rows_as_written(spark, tmp_path):
    """Extra columns, and far more rows than a range's sample has."""
    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), F.xxhash64("id").alias("other"), F.format_string("row %d", "id").alias("text"))
    datasets.numbered(rows, ["k"], "pos", 64).write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p"))
    assert tuple(got.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()) == (400_000, 400_000, 0, 399_999)
    by_key = got.where("k < 50").orderBy("k").collect()
    assert [r["pos"] for r in by_key] == sorted(r["pos"] for r in by_key)
    sizes = datasets.batches(rows.select("k", "text"), "k", 32).groupBy("batch").count()
    assert sizes.where("count != 32").count() == 0 and sizes.count() == 12_500
    assert datasets.numbered(rows.limit(0), ["k"], "pos").count() == 0


SUMS = "problem_id long, question string, fn_name string, tests struct<inputs: array<string>, outputs: array<string>, fn_name: string>"


def test_rollouts_of_one_file_are_dealt_out(spark, tmp_path):
    df = spark.createDataFrame([(i, f"q{i}", None, (["1"], ["1"], None)) for i in range(40)], SUMS).coalesce(1)
    r = loops.multi_turn(spark, df, str(tmp_path), lambda p, s: p.map(lambda _: "<interact>print(1)"), 2, 1)
    assert r.count() == 80 and r.where("has_interacted").count() == 80
    assert spark.read.parquet(str(tmp_path / "round=0")).select(F.input_file_name()).distinct().count() > 1


def test_candidates_are_asked_for_once(spark, tmp_path):
    (notes := tmp_path / "notes").touch()
    path = str(notes)

    def speak(prompts, seeds):
        with open(path, "a") as f:
            f.write("x" * len(prompts))
        return prompts.map(lambda _: "```python\nprint(1)\n```")

    df = spark.createDataFrame([(i, f"q{i}", None, (["1"], ["1"], None)) for i in range(3)], SUMS)
    out = loops.aggregated(spark, df, str(tmp_path / "run"), speak, loops.by_harness(df), 4, 2, 2)
    assert out.count() == 24 and out.where("final_reward = 1").count() == 24
    assert len(notes.read_text()) == 24


def test_reevaluation_of_repeated_keys(spark):
    schema = "problem_id long, messages array<struct<role: string, content: string>>, tests struct<inputs: array<string>, outputs: array<string>, fn_name: string>, final_reward double, terminated boolean, truncated boolean"
    said = lambda x: [("user", "q"), ("assistant", f"```python\nprint({x})\n```")]
    active = spark.createDataFrame([(7, said(x), (["1"], ["1"], None), None, False, False) for x in (1, 2)], schema)
    done = spark.createDataFrame([(1, 0.5, True, False)], "problem_id long, final_reward double, terminated boolean, truncated boolean")
    got = loops.reevaluated(done, active, ["problem_id"]).collect()
    assert sorted((r["problem_id"], r["final_reward"], r["from_active"]) for r in got) == [(1, 0.5, False), (7, 0.0, True), (7, 1.0, True)]
