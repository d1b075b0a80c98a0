"""Runs and their registry, files by bytes, packed texts, catalogues."""

import base64
import json
import os
import pickle
import threading
import zlib
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import packed
from tessera.operators import loops
from tessera.sources import tables
from tessera.sources.runs import Registry, Taken, run_name


def test_run_names_sort_by_time():
    a, b = run_name(datetime(2026, 1, 17, 14, 30, 52)), run_name(datetime(2026, 1, 17, 14, 30, 53))
    assert a.startswith("20260117_143052_") and len(a) == 24 and a < b and run_name() != run_name()


def test_registry(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "runs"))
    assert r.newest() is None and r.runs() == [] and r.version() == 0
    with pytest.raises(FileNotFoundError):
        r.info()
    first = r.publish({"states": spark.range(5), "done": spark.range(0)}, model="x", num_samples=2)
    second = r.publish({"states": spark.range(7)}, model="y", num_samples=2)
    assert r.runs() == [second, first] and r.table("states").count() == 7 and r.table("states", first).count() == 5
    assert r.info()["tables"] == {"states": 7} and r.info(first)["tables"] == {"states": 5, "done": 0}
    assert r.drift(first, model="z", num_samples=2) == ["model: x then, z now"]
    assert r.resumed(model="y", num_samples=2)[1] == []
    with pytest.raises(ValueError, match="model"):
        r.resumed(strict=True, model="x", num_samples=2)
    assert r.publish({}, name="only-settings", a=1) == "only-settings" and r.info()["settings"] == {"a": 1}
    with pytest.raises(Taken):
        r.publish({}, name="only-settings")


def test_a_half_written_run_is_never_read(spark, tmp_path):
    r = Registry(spark, str(tmp_path))
    first = r.publish({"t": spark.range(1)})
    # a writer that died while it wrote, one that died before its entry, one within it
    spark.range(9).write.parquet(f"{tmp_path}/_draft/dead/t")
    spark.range(9).write.parquet(f"{tmp_path}/{run_name()}/t")
    Path(tmp_path, "_log", "claim-000000000002").touch()
    assert r.runs() == [first] and r.table("t").count() == 1
    third = r.publish({"t": spark.range(3)})
    assert r.runs() == [third, first] and r.version() == 3


def test_of_two_writers_one_wins(spark, tmp_path):
    r = Registry(spark, str(tmp_path))
    base = r.publish({"t": spark.range(1)})
    seen, barrier = [], threading.Barrier(4)

    def write(i):
        mine = Registry(spark, str(tmp_path))
        at = mine.version()
        barrier.wait()
        try:
            seen.append((i, mine.publish({"t": spark.range(10 + i)}, after=at)))
        except Taken:
            seen.append((i, None))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [(i, run) for i, run in seen if run]
    assert len(seen) == 4 and len(won) == 1 and r.runs() == [won[0][1], base] and r.table("t").count() == 10 + won[0][0]
    assert sorted(x for x in os.listdir(tmp_path) if x[0] != "_") == sorted([base, won[0][1]])


def test_rounds_warn_of_other_settings(spark, tmp_path):
    make = lambda: spark.range(2)
    loops.Rounds(spark, str(tmp_path), num_samples=2).table("p", make)
    loops.Rounds(spark, str(tmp_path), num_samples=2).table("p", make)
    with pytest.warns(UserWarning, match="num_samples: 2 then, 3 now"):
        assert loops.Rounds(spark, str(tmp_path), num_samples=3).table("p", make).count() == 2
    with pytest.raises(ValueError, match="num_samples"):
        loops.Rounds(spark, str(tmp_path), strict=True, num_samples=3).table("p", make)


def sizes(path):
    return sorted(p.stat().st_size for p in Path(path).glob("*.parquet"))


@pytest.mark.parametrize("order", [None, ["id"]])
def test_no_file_beyond_the_limit(spark, tmp_path, order):
    # rows of a few bytes to a few hundred thousand, that don't compress
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 500 == 0, 4000).when(F.col("id") % 50 == 7, 300).otherwise(2)), lambda i: F.sha2(F.concat_ws(",", "id", i), 256)), "")
    df = spark.range(4000).select("id", noise.alias("text"), F.array("id").alias("ids"), (F.col("id") / 3).alias("x")).repartition(3)
    limit = 400_000
    n = tables.save_by_bytes(df, str(tmp_path / "t"), limit, order)
    found = sizes(tmp_path / "t")
    assert len(found) == n and max(found) <= limit and n < 3 * sum(found) / limit + 8
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4000 and back.exceptAll(df).count() == 0
    if order:
        ends = back.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
        assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_files_by_bytes_of_odd_tables(spark, tmp_path):
    assert tables.save_by_bytes(spark.range(0), str(tmp_path / "none"), 1000) == 0 and spark.read.parquet(str(tmp_path / "none")).columns == ["id"]
    huge = spark.createDataFrame([(1, "x" * 300_000, None), (2, None, {"a": 1}), (3, "", {})], "id int, t string, m map<string,int>")
    assert tables.save_by_bytes(huge, str(tmp_path / "huge"), 100_000, ["id"]) in (2, 3)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "huge")).orderBy("id").collect()] == [1, 2, 3]


def test_a_task_writes_many_files(spark, tmp_path):
    df = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("file"))
    began = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    n = tables.save_by_bytes(df, str(tmp_path / "t"), 67_000, ["id"])
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in set(tracker.getJobIdsForGroup()) - began for s in tracker.getJobInfo(j).stageIds]
    assert n > 50 and len(sizes(tmp_path / "t")) == n and max(s.numTasks for s in stages if s) < n
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == ["id", "file"] and back.count() == 3000 and back.exceptAll(df).count() == 0
    assert not (tmp_path / "t" / "_files").exists() and (tmp_path / "t" / "_SUCCESS").exists()


def pack(value, protocol=4):
    return base64.b64encode(zlib.compress(pickle.dumps(value, protocol))).decode()


class Hostile:
    def __reduce__(self):
        return os.system, ("touch /tmp/never",)


@pytest.mark.parametrize("protocol", range(5))
def test_packed_texts_are_read(protocol):
    for text in ("[]", '[{"input": "ü"}]' * 50, "x" * 70_000):
        assert packed.unfolded(pack(text, protocol)) == text


@pytest.mark.parametrize("value", [Hostile(), ["[]"], ("[]",), {"a": "[]"}, 5, None, b"[]", print])
def test_other_pickles_are_refused(value):
    assert packed.unfolded(pack(value)) is None and not os.path.exists("/tmp/never")


def test_broken_packed_texts_are_refused():
    whole = pack("[]")
    assert packed.unfolded(whole[:-8]) is None and packed.unfolded("!!!") is None and packed.unfolded("") is None
    two = base64.b64encode(zlib.compress(b"\x80\x04\x8c\x01a\x8c\x01b.")).decode()
    assert packed.unfolded(two) is None
    assert packed.unfolded(pack("x" * 5_000_000), limit=1_000_000) is None  # unfolds too far


def test_packed_cases_of_contests(spark):
    cases = json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}])
    rows = [("a", cases, cases), ("b", cases, pack(cases)), ("c", cases, pack(Hostile())), ("d", cases, None), ("e", None, pack("not json")), ("f", cases, "")]
    df = spark.createDataFrame([(q, "", a, b, "{}") for q, a, b in rows], "question_content string, starter_code string, public_test_cases string, private_test_cases string, metadata string")
    from tessera.operators.problems import benchmark_problems

    got = {r["question"][0]: (len(r["info"]["tests"]["inputs"]), r["refused"]) for r in benchmark_problems(df, "t").collect()}
    assert got == {"a": (2, False), "b": (2, False), "c": (1, True), "d": (1, False), "e": (0, True), "f": (1, False)}


def test_catalog_reads_versions(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "easy"))
    spark.range(2).write.parquet(str(tmp_path / "easy@v1"))
    c = tables.Catalog(str(tmp_path), {"low": "easy"})
    assert c.read(spark, "low").count() == 3 and c.read(spark, "low", "v1").count() == 2
    with pytest.raises(KeyError):
        c.read(spark, "high")
