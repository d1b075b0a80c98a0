"""Problem sources in one shape: prompt, answer, info, task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.packed import unpacked_json
from tessera.functions.text import fenced
from tessera.operators.datasets import numbered, seeded_subset
from tessera.schemas import TESTS

# What a question ends in, with starter code and without.
STARTER_BEGIN = "\n\nYou will use the following starter code to write the solution to the problem and enclose your code within ```python delimiters.\n\n```python\n"
STARTER_END = "\n```"
NO_STARTER = "\n\nRead the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within ```python delimiters."

_CASES = "array<struct<input:string,output:string,fn_name:string,testtype:string>>"


@dataclass(frozen=True)
class Source:
    """How a source says things: whether its tests are a list of cases, whether
    its first solution is an answer, and where the function's name is (with the
    tests, in the first case, or in the metadata of functional tests)."""

    subset: str
    cases: bool
    solved: bool
    name_in: str
    question: str = "problem"


SOURCES = {
    "taco": Source("taco", False, True, "tests"),
    "primeintellect": Source("primeintellect", True, True, "case"),
    "fares": Source("i3-code", False, False, "tests", "question"),
    "codeforces": Source("codeforces", True, False, "case"),
    "lcbv5": Source("lcbv5", True, False, "metadata"),
}


def _drawn(inputs: Column, outputs: Column, most: int, *seed: Column) -> tuple[Column, Column]:
    """Up to *most* tests: all in order, or a seeded draw in shuffled order."""
    both = F.arrays_zip(inputs.alias("i"), outputs.alias("o"))
    few = F.when(F.size(inputs) <= most, both).otherwise(seeded_subset(both, most, *seed))
    return F.transform(few, lambda x: x["i"]), F.transform(few, lambda x: x["o"])


def training_problems(df: DataFrame, source: str, order: str, most: int = 15, seed: int = 42) -> DataFrame:
    """(prompt, answer, info, task) of a source's rows, numbered by *order*.

    Tests are JSON text; each chosen input and output stays the JSON text of its
    value. Text that isn't JSON has no tests (null)."""
    s = SOURCES[source]
    text = F.get_json_object("info", "$.tests") if source == "fares" else F.col("tests")
    rows = numbered(df, [order], "subset_idx")
    if s.cases:
        cases = F.from_json(text, _CASES)
        inputs, outputs = F.transform(cases, lambda x: x["input"]), F.transform(cases, lambda x: x["output"])
        first = F.get(cases, F.lit(0))
        name = first["fn_name"] if s.name_in == "case" else F.when(first["testtype"] == "functional", F.col("metadata.func_name"))
    else:
        tests = F.from_json(text, TESTS)
        inputs, outputs, name = tests["inputs"], tests["outputs"], tests["fn_name"]
    rows = rows.withColumns({"__in": inputs, "__out": outputs, "__fn": F.coalesce(name, F.lit(""))})
    few_in, few_out = _drawn(F.col("__in"), F.col("__out"), most, F.lit(seed), F.col("subset_idx"))
    answer = fenced(F.get("solutions", F.lit(0))) if s.solved and "solutions" in df.columns else F.lit("")
    origin = F.get_json_object("info", "$.source") if source == "fares" else F.lit(None).cast("string")
    info = F.struct(F.lit(s.subset).alias("subset"), "subset_idx", F.struct(few_in.alias("inputs"), few_out.alias("outputs"), F.col("__fn").alias("fn_name")).alias("tests"), F.col("__fn").alias("fn_name"), origin.alias("source"))
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col(s.question).alias("content")))
    return rows.select(prompt.alias("prompt"), F.coalesce(answer, F.lit("")).alias("answer"), info.alias("info"), F.lit("deepcoder").alias("task"))


def with_instructions(question: Column, starter: Column) -> Column:
    """A question with its starter code, or with what to do without one."""
    has = F.length(F.coalesce(starter, F.lit(""))) > 0
    return F.concat(F.coalesce(question, F.lit("")), F.when(has, F.concat(F.lit(STARTER_BEGIN), starter, F.lit(STARTER_END))).otherwise(F.lit(NO_STARTER)))


def benchmark_problems(df: DataFrame, tag: str) -> DataFrame:
    """(question, info, refused) of contest rows: public and private cases together.
    Private cases are JSON, or JSON packed as one pickled string, which is read
    without unpickling; what is neither is refused and left out."""
    private = unpacked_json("private_test_cases")
    rows = df.withColumns({"__public": F.coalesce(F.from_json("public_test_cases", _CASES), F.array().cast(_CASES)), "__private": private})
    cases = F.concat("__public", F.coalesce(F.from_json("__private.value", _CASES), F.array().cast(_CASES)))
    tests = F.struct(F.transform(cases, lambda x: x["input"]).alias("inputs"), F.transform(cases, lambda x: x["output"]).alias("outputs"), F.get_json_object("metadata", "$.func_name").alias("fn_name"))
    info = F.struct(tests.alias("tests"), F.lit(tag).alias("source"))
    return rows.select(with_instructions(F.col("question_content"), F.col("starter_code")).alias("question"), info.alias("info"), (F.col("__private.kind") == "refused").alias("refused"))


def idle_devices(rows: DataFrame, utilisation: float = 5, memory: float = 500, by: list[str] | None = None) -> DataFrame:
    """(all_idle, n_idle) of device rows, or of each group of them."""
    idle = (F.col("utilisation") <= utilisation) & (F.col("memory") <= memory)
    return rows.groupBy(*(by or [])).agg(F.bool_and(idle).alias("all_idle"), F.count_if(idle).alias("n_idle"))
