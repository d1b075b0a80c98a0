"""Combining, comparing, filtering and ranking datasets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded
from tessera.operators.prefix import ordinals
from tessera.storage import cut


def common_problems(a: DataFrame, b: DataFrame, problem: str = "problem_id") -> DataFrame:
    return a.select(problem).intersect(b.select(problem))


def restricted(df: DataFrame, ids: DataFrame, problem: str = "problem_id") -> DataFrame:
    return df.join(ids, problem, "left_semi")


def merge_offsets(names: Sequence[str], sizes: Sequence[int], explicit: Sequence[int | None] | None = None) -> list[int]:
    """The offset of each dataset: a stated one, else the start in a name that
    ends in _start_end, else 0 for the first and for others the end of the one
    before (its offset and its largest id, plus one). *sizes* has largest id + 1."""
    out, end = [], 0
    for i, (name, size) in enumerate(zip(names, sizes)):
        found = re.search(r"_(\d+)_(\d+)$", name)
        if explicit and i < len(explicit) and explicit[i] is not None:
            offset = explicit[i]
        elif found:
            offset = int(found[1])
        else:
            offset = end if i else 0
        out.append(offset)
        end = offset + size
    return out


def merged(datasets: Sequence[tuple[str, DataFrame]], explicit: Sequence[int | None] | None = None) -> DataFrame:
    """All rows with problem ids moved, their originals and the dataset's name.
    Trajectory ids stay as they are. Of each dataset one number reaches the
    driver, its largest id."""
    sizes = [(df.agg(F.max("problem_id")).first()[0] or 0) + 1 if not df.isEmpty() else 0 for _, df in datasets]
    offsets = merge_offsets([n for n, _ in datasets], sizes, explicit)
    out = None
    for (name, df), offset in zip(datasets, offsets):
        part = df.withColumns({"original_problem_id": F.col("problem_id"), "original_trajectory_id": F.col("trajectory_id"), "problem_id": F.col("problem_id") + offset, "source_dataset": F.lit(name)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset")
    return out


def id_extents(df: DataFrame) -> DataFrame:
    """Of each problem the largest trajectory id plus one."""
    return df.groupBy("problem_id").agg((F.max("trajectory_id") + 1).alias("num_trajectories"))


def numbered(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the position of each row in a total order, from 0, without bringing
    the rows to one task.

    Ranges of the order are sorted and written once, each row with its range and
    its place there; what is read back alone decides, so ranges that another
    sample would draw elsewhere can't mix. A range starts where the sizes of those
    before it end, a number for each range. Rows that tie take any order among
    themselves; an empty table gives an empty one."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of ranges is not coalesced; the id holds the range above its 33rd bit
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each range
    return joined.withColumn(name, (F.col("__before") + row).cast("long")).drop("__part", "__at", "__before")


def hardest(df: DataFrame, samples: int = 320, also_in: DataFrame | None = None, digits: int = 8) -> DataFrame:
    """Problems with at least *samples* samples (and rows in *also_in*), hardest
    first: rate of full rewards among the first samples, then id. rank is from 0."""
    first = ordinals(df).withColumn("n", F.count("*").over(Window.partitionBy("problem_id"))).where((F.col("n") >= samples) & (F.col("k") <= samples))
    rate = first.groupBy("problem_id").agg(rounded(F.avg(F.when(F.col("final_reward") == 1.0, 1.0).otherwise(0.0)), digits).alias("success_rate"))
    if also_in is not None:
        rate = restricted(rate, also_in.select("problem_id").distinct())
    return numbered(rate, ["success_rate", "problem_id"], "rank")


def hardest_rows(ranked: DataFrame, problems: DataFrame, x: int, index: str) -> DataFrame:
    """Rows of the x hardest, renumbered in rank order; ids that the table lacks
    go. Columns original_problem_id and problem_id are added."""
    top = ranked.where(F.col("rank") < x).select(F.col("problem_id").alias(index), "rank")
    joined = problems.join(top, index).withColumn("original_problem_id", F.col(index))
    return numbered(joined, ["rank"], "problem_id").drop("rank")


def assert_hard(ranked: DataFrame, count: int = 300) -> None:
    """There are *count* ranked problems and none of the first has a success."""
    row = ranked.where(F.col("rank") < count).agg(F.count("*").alias("n"), F.max("success_rate").alias("top")).first()
    if row["n"] < count or row["top"] != 0:
        raise AssertionError(f"{row['n']} problems, highest rate {row['top']}")


def in_closed_range(c: Column, low: float, high: float, missing: float | None = None) -> Column:
    """low <= c <= high; null is out, unless *missing* stands for it."""
    c = c if missing is None else F.coalesce(c, F.lit(missing))
    return F.coalesce(c.between(low, high), F.lit(False))


def contest_date(text: Column, literal: bool = False) -> Column:
    """A time from text in one of three formats, with T or a space; null if none
    fits. What follows the seconds is ignored.

    *literal* cuts the text at the length of each format's own notation (17, 14
    and 8), as one program does; then only unpadded dates can be read."""
    t = F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19)
    formats = (("yyyy-M-d H:m:s", 17), ("yyyy-M-d H:m", 14), ("yyyy-M-d", 8)) if literal else (("yyyy-M-d H:m:s", 19), ("yyyy-M-d H:m", 16), ("yyyy-M-d", 10))
    return F.coalesce(*[F.try_to_timestamp(F.substring(t, 1, n), F.lit(f)) for f, n in formats])


def in_half_open(c: Column, start: str, end: str) -> Column:
    return F.coalesce((c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz")), F.lit(False))


def positional(df: DataFrame, order: str, start: int, count: int | None) -> DataFrame:
    """Rows start.. of a stated order, clipped to what is there."""
    placed = numbered(df, [order], "__pos").where(F.col("__pos") >= start)
    return (placed if count is None else placed.where(F.col("__pos") < start + count)).drop("__pos")


def exactly_one(df: DataFrame, condition: Column) -> DataFrame:
    found = df.where(condition).limit(2)
    if found.count() != 1:
        raise LookupError("not exactly one row")
    return found


def draw(*parts) -> Column:
    """A draw's text, which any engine gives: the hexadecimal md5 of the parts, as
    text, joined by commas."""
    return F.md5(F.concat_ws(",", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def draw_number(*parts) -> Column:
    """The same as a number of 60 bits."""
    return F.conv(F.substring(draw(*parts), 1, 15), 16, 10).cast("long")


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed shuffle: adds each row's position, from 0, by its draw of seed and
    key; no task has all rows. Rows of one key follow one another."""
    return numbered(df.withColumn("__draw", draw(F.lit(seed), F.col(key))), ["__draw", key], "position").drop("__draw")


def seeded_subset(values: Column, n: int, *seed: Column) -> Column:
    """n entries of an array without replacement, in shuffled order; which ones
    depends on the draws of the seeds and their places alone."""
    keyed = F.transform(values, lambda v, i: F.struct(draw(*seed, i).alias("h"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["v"])


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds a batch number, counted through the stated order."""
    return numbered(df, [order], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def cycled(df: DataFrame, order: str, size: int, n_batches: int) -> DataFrame:
    """*n_batches* batches of *size* rows through the stated order, which begins
    anew at its end; adds batch. An empty table gives none."""
    n = df.count()
    placed = numbered(df, [order], "__pos")
    wanted = n_batches * size
    again = F.explode(F.sequence(F.col("__pos"), F.lit(wanted - 1).cast("long"), F.lit(max(n, 1)).cast("long")))
    return placed.where(F.col("__pos") < wanted).withColumn("batch", again).withColumn("batch", F.floor(F.col("batch") / size).cast("long")).drop("__pos")


def choices_by_prompt(choices: DataFrame, n: int, index: str = "index") -> DataFrame:
    """(prompt_index, sequences): the answers of a completion call, *n* for each
    prompt and numbered through, by prompt in order. Columns but the index are an
    answer's."""
    own = [c for c in choices.columns if c != index]
    rows = choices.withColumn("prompt_index", F.floor(F.col(index) / n).cast("long"))
    held = rows.groupBy("prompt_index").agg(F.array_sort(F.collect_list(F.struct(index, *own))).alias("s"))  # n entries
    return held.select("prompt_index", F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in own])).alias("sequences"))


def sharded(df: DataFrame, index: str, n: int) -> DataFrame:
    """Round robin over *n* clients: adds client. Rows keep their index, by which
    answers are put together again."""
    return df.withColumn("client", F.pmod(F.col(index), F.lit(n)).cast("int"))


def reassembled(asked: DataFrame, answered: DataFrame, index: str) -> DataFrame:
    """Every question with its answer; raises if one has none."""
    if not asked.join(answered, index, "left_anti").isEmpty():
        raise RuntimeError("answers are incomplete")
    return asked.join(answered, index)


def interaction_codes(df: DataFrame, most: int | None = None, interactions: str = "interactions") -> DataFrame:
    """(problem_id, trajectory_id, pos, code) of the interactions whose code isn't
    blank; the first *most* in that order, if stated."""
    rows = df.select("problem_id", "trajectory_id", F.posexplode(interactions).alias("pos", "i")).select("problem_id", "trajectory_id", "pos", F.col("i.code").alias("code"))
    rows = rows.where(F.length(F.trim(F.regexp_replace(F.coalesce("code", F.lit("")), r"(?U)\s+", " "))) > 0)
    return rows if most is None else rows.orderBy("problem_id", "trajectory_id", "pos").limit(most)


def first_problems(df: DataFrame, n: int) -> DataFrame:
    """All rows of the problems below *n*."""
    return df.where(F.col("problem_id") < n)


def seeded_rollouts(problems: DataFrame, samples: int) -> DataFrame:
    """A row for each problem and sample."""
    return problems.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def missing_from(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the spans [low, high) that hold them, by buckets of *width*."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(s, "__b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the newest right value of its key at or before it."""
    both = left.withColumn(value, F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__right", F.lit(False)).unionByName(right.select(key, time, value).withColumn("__right", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(time), F.col("__right").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where(~F.col("__right")).drop("__right")
