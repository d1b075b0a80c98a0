"""Queries on sources, sinks and small text and JSON forms."""

from __future__ import annotations

import base64
import pickle
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import nested, packed, text
from tessera.operators import loops, problems
from tessera.operators.datasets import draw_number
from tessera.operators.harness import dealt
from tessera.plans.programs import answering
from tessera.plans.programs import problems as programs
from tessera.plans.registry import query
from tessera.schemas import TESTS
from tessera.sources import tables
from tessera.sources.runs import Registry
from tessera.sources.tables import table
from tessera.storage import shared_path


@F.pandas_udf(StringType())
def _packed(texts: pd.Series, hostile: pd.Series) -> pd.Series:
    return pd.Series([base64.b64encode(zlib.compress(pickle.dumps([t] if h else t))).decode() for t, h in zip(texts, hostile)], index=texts.index)


def _cases(lead: str) -> Column:
    """JSON of two cases of a part, as text."""
    one = lambda i: F.struct(F.concat(F.lit(lead), F.lit(f"{i} "), F.col("p_partkey")).alias("input"), F.col("p_size").cast("string").alias("output"), F.when(F.col("p_partkey") % 2 == 0, "solve").alias("fn_name"), F.lit("stdin").alias("testtype"))
    return F.to_json(F.array(one(1), one(2)))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'packed' WHEN 2 THEN 'refused' ELSE 'empty' END AS kind, CASE WHEN p_partkey % 4 < 2 THEN 4 ELSE 2 END AS n_cases, p_partkey % 4 = 2 AS refused,
    concat('a1 ', p_partkey, CASE WHEN p_partkey % 4 < 2 THEN concat(' b2 ', p_partkey) ELSE concat(' a2 ', p_partkey) END) AS ends FROM part"""
)
def packed_cases(spark, d):
    """Contest rows whose private cases are JSON, packed, a packed list, or absent."""
    p = table(spark, d, "part")
    k, private = F.col("p_partkey") % 4, _cases("b")
    form = F.when(k == 0, private).when(k < 3, _packed(private, k == 2)).otherwise("")
    rows = p.select("p_partkey", _cases("a").alias("public_test_cases"), form.alias("private_test_cases"), F.col("p_partkey").cast("string").alias("question_content"), F.lit("").alias("starter_code"), F.lit("{}").alias("metadata"))
    kinds = rows.select("p_partkey", packed.unpacked_json("private_test_cases")["kind"].alias("kind"))
    made = problems.benchmark_problems(rows, "t").select(F.split_part("question", F.lit("\n"), F.lit(1)).cast("long").alias("p_partkey"), F.col("info.tests.inputs").alias("i"), "refused")
    return kinds.join(made, "p_partkey").select("p_partkey", "kind", F.size("i").alias("n_cases"), "refused", F.concat_ws(" ", F.element_at("i", 1), F.element_at("i", -1)).alias("ends"))


@query(
    """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part), c AS (SELECT p_partkey, k, i, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws(',', 42, k, i))) AS r FROM n, (SELECT unnest(range(20)) AS i))
    SELECT k AS subset_idx, 'taco' AS subset, concat('Part ', p_partkey) AS prompt, CASE WHEN p_partkey % 3 = 0 THEN concat(repeat(chr(96), 3), 'py') ELSE concat(repeat(chr(96), 3), 'python', chr(10), 'x', chr(10), repeat(chr(96), 3)) END AS answer,
    string_agg(i, ' ' ORDER BY r) FILTER (r <= 15) AS inputs, CASE WHEN p_partkey % 2 = 0 THEN 'solve' ELSE '' END AS fn_name FROM c GROUP BY p_partkey, k"""
)
def problem_sources(spark, d):
    """Parts as problems of a source: numbered, fenced, fifteen of twenty tests drawn."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i.cast("string"))
    fn = F.when(F.col("p_partkey") % 2 == 0, "solve")
    fence = F.when(F.col("p_partkey") % 3 == 0, "```py").otherwise("x")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Part "), "p_partkey").alias("problem"), F.to_json(F.struct(numbers.alias("inputs"), numbers.alias("outputs"), fn.alias("fn_name"))).alias("tests"), F.array(fence).alias("solutions"))
    out = problems.training_problems(rows, "taco", "p_partkey")
    return out.select("info.subset_idx", "info.subset", F.col("prompt")[0]["content"].alias("prompt"), "answer", F.array_join("info.tests.inputs", " ").alias("inputs"), "info.fn_name")


@query(
    r"""SELECT p_partkey, concat('Q', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), chr(10), 'You will use the following starter code to write the solution to the problem and enclose your code within ', repeat(chr(96), 3), 'python delimiters.', chr(10), chr(10), repeat(chr(96), 3), 'python', chr(10), 'def f', chr(10), repeat(chr(96), 3))
    ELSE concat(chr(10), chr(10), 'Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within ', repeat(chr(96), 3), 'python delimiters.') END) AS question FROM part"""
)
def starter_questions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", problems.with_instructions(F.concat(F.lit("Q"), "p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "def f")).alias("question"))


@query("SELECT s_nationkey, bool_and(s_suppkey % 7 <= 5 AND s_suppkey * 10 <= 500) AS all_idle, count(*) FILTER (s_suppkey % 7 <= 5 AND s_suppkey * 10 <= 500) AS n_idle FROM supplier GROUP BY s_nationkey")
def idle_devices(spark, d):
    """Suppliers as devices of a nation."""
    s = table(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 7).cast("double").alias("utilisation"), (F.col("s_suppkey") * 10).cast("double").alias("memory"))
    return problems.idle_devices(s, by=["s_nationkey"])


@query(
    r"""SELECT p_partkey, CASE WHEN k = 0 THEN p_size END AS value, CASE WHEN k = 0 THEN p_size ELSE -1 END AS filled, CASE WHEN k = 1 THEN 'nope' END AS raw, CASE WHEN k = 0 THEN concat('{', p_partkey, ': [', p_size, ']}') ELSE '{"a":1}' END AS keyed,
    concat('{"v":"', p_size, '"} {"v":"x"}') AS each, concat(p_size, chr(10), 'x') AS joined, concat('1', ' ', CASE WHEN k = 0 THEN '' ELSE 'b ' END, '2') AS outputs, concat('[1, ', p_size, ']') AS literal, TRUE AS refused
    FROM (SELECT *, p_partkey % 3 AS k FROM part)"""
)
def json_forms(spark, d):
    """JSON that can be read, that can't, and none; keys, entries and cases of it."""
    size, k = F.col("p_size"), F.col("p_partkey") % 3
    told = F.when(k == 0, F.to_json(F.struct(size.alias("a")))).when(k == 1, "nope")
    raw = nested.parsed_or_raw("t", "a int")
    keyed = F.when(k == 0, F.concat(F.lit('{"'), "p_partkey", F.lit('": ['), size.cast("string"), F.lit("]}"))).otherwise('{"a":1}')
    case = lambda i, o: F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"))
    _, outputs = nested.test_cases(F.array(case("x", "1")), F.when(k == 0, F.array(case("y", "2"))).otherwise(F.array(case("y", "b"), case("z", "2"))))
    literal = nested.literals(F.concat(F.lit("[1, "), size.cast("string"), F.lit("]\nopen('x')")))
    return table(spark, d, "part").withColumn("t", told).select(
        "p_partkey", nested.parsed("t", "a int")["a"].alias("value"), nested.parsed("t", "a int", "empty", F.struct(F.lit(-1).alias("a")))["a"].alias("filled"), raw["raw"].alias("raw"), nested.integer_keys(keyed).alias("keyed"),
        F.array_join(nested.each_json(F.array(size.cast("string"), F.lit("x"))), " ").alias("each"), nested.joined_lines(F.array(size.cast("string"), F.lit("x"))).alias("joined"), F.array_join(outputs, " ").alias("outputs"),
        literal[0].alias("literal"), literal[1].isNull().alias("refused"),
    )


@query(
    """SELECT doc_id, CASE k WHEN 0 THEN 'said' WHEN 1 THEN '' ELSE concat(doc_id, ' said ') END AS answer, CASE k WHEN 0 THEN CAST(doc_id AS VARCHAR) ELSE concat('"', doc_id) END AS unquoted, CASE k WHEN 2 THEN NULL ELSE doc_id END AS low, CASE k WHEN 2 THEN NULL ELSE doc_id + 5 END AS high,
    CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 50), '...') ELSE text END AS preview,
    concat('<output>', chr(10), CASE k WHEN 0 THEN text WHEN 1 THEN '(no output during interaction -- did you forget to print? did you enclose the code correctly in <interact></interact>?)' WHEN 2 THEN concat('Error:', chr(10), 'It TIMED Out') ELSE 'Error: execution failed.' END, '</output>') AS shown,
    k = 2 AS late, concat('a', chr(10), 'c ', doc_id) AS code FROM (SELECT *, doc_id % 4 AS k FROM documents)"""
)
def text_forms(spark, d):
    """Answers after thoughts, quoted texts, ranges in names, previews, what runs
    show, programs without their main block."""
    k, doc = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    thought = F.when(k == 0, F.concat(F.lit("<think>"), doc, F.lit("</think>\n said "))).when(k == 1, F.concat(F.lit("<think> "), doc)).otherwise(F.concat(doc, F.lit(" said ")))
    quoted = F.when(k == 0, F.concat(F.lit(' "'), doc, F.lit('" '))).otherwise(F.concat(F.lit('"'), doc, F.lit("\n")))
    low, high = text.id_range(F.when(k == 2, "set").otherwise(F.concat_ws("_", F.lit("set"), doc, (F.col("doc_id") + 5).cast("string"))))
    err = F.when(k == 2, "It TIMED Out").otherwise("")
    program = F.concat(F.lit("a\nif __name__ == '__main__':\n    b\n\n    b()\nc "), doc)
    return table(spark, d, "documents").select(
        "doc_id", text.after_think(thought).alias("answer"), text.unquoted(quoted).alias("unquoted"), low.alias("low"), high.alias("high"), text.preview("text", 50).alias("preview"),
        text.framed_output(F.when(k == 0, F.col("text")).otherwise(""), err, k < 2).alias("shown"), text.timed_out(err).alias("late"), nested.without_main(program).alias("code"),
    )


@query(
    """SELECT p_partkey AS problem_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(CAST(concat('0x', substr(md5(concat_ws(',', p_partkey, 9)), 1, 15)) AS BIGINT) % 3 <> 0 AS DOUBLE) END AS final_reward, p_partkey % 2 = 0 AS terminated, p_partkey % 2 = 1 AS truncated, p_partkey % 2 = 1 AS from_active
    FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0"""
)
def checkpoint_reevaluated(spark, d):
    """Completed rollouts keep their reward; active ones are scored on their last
    answer, and go if they have none."""
    p = programs(spark, d)
    completed = p.where("problem_id % 2 = 0").select("problem_id", F.lit(0.25).alias("final_reward"), F.lit(True).alias("terminated"), F.lit(False).alias("truncated"))
    told = loops.generated(dealt(p.where("problem_id % 2 = 1"), ["problem_id"]).withColumn("seed", draw_number("problem_id", F.lit(9))), "question", "seed", answering, "said")
    said = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    talk = F.when(F.col("problem_id") % 5 == 0, F.array(said("user", F.col("question")))).otherwise(F.array(said("user", F.col("question")), said("assistant", F.lit("hm")), said("user", F.lit("go on")), said("assistant", F.col("said"))))
    active = told.select("problem_id", talk.alias("messages"), F.col("tests").cast(TESTS).alias("tests"), F.lit(None).cast("double").alias("final_reward"), F.lit(False).alias("terminated"), F.lit(False).alias("truncated"))
    return loops.reevaluated(completed, active, ["problem_id"]).select("problem_id", "final_reward", "terminated", "truncated", "from_active")


@query("SELECT doc_id, text, TRUE AS within FROM documents")
def files_by_bytes(spark, d):
    """Documents written to files of at most 200,000 bytes and read back."""
    path, limit = shared_path(spark, "by_bytes"), 200_000
    tables.save_by_bytes(table(spark, d, "documents").select("doc_id", "text"), path, limit, ["doc_id"])
    # a row of over half a file's room is alone, whatever its size
    alone = F.octet_length("text") > limit // 3
    return spark.read.parquet(path).select("doc_id", "text", (alone | (F.col("_metadata.file_size") <= limit)).alias("within"))


@query("SELECT l_orderkey, l_linenumber, 2 AS n_runs, (SELECT count(*) FROM lineitem) AS n_rows, 'num_samples: 2 then, 3 now' AS changed FROM lineitem")
def run_registry(spark, d):
    """Two runs of lines are published, and an unfinished one is left; the newest is
    read."""
    r = Registry(spark, shared_path(spark, "runs"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    r.publish({"lines": lines.where("l_linenumber = 1")}, num_samples=1)
    r.publish({"lines": lines}, num_samples=2)
    lines.limit(1).write.parquet(f"{r.root}/99990101_000000_00000000/lines")  # its writer is gone
    rows = r.info()["tables"]["lines"]
    return r.table("lines").select("l_orderkey", "l_linenumber", F.lit(len(r.runs())).alias("n_runs"), F.lit(rows).cast("long").alias("n_rows"), F.lit("; ".join(r.drift(num_samples=3))).alias("changed"))
