"""Document fingerprints by winnowing.

Every k-gram of a whole text gets a rolling hash; of each window of w
consecutive hashes the smallest is kept, the rightmost of equal ones, with its
position.  Two texts that share w + k - 1 characters in a row therefore share a
kept hash.  A text with fewer than k characters has its own hash as its only
k-gram; one with fewer than w k-grams has one window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import INVERSE, cut, mix64, powers, prefix_hash, texts_of

GRAM = 20
WINDOW = 21
#: Equal rows that are told together.
CHUNK = 10_000
LOWEST = -(2**63)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def fingerprint(chars: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(kept hashes, their positions) of a text's code points."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(gram, n)
    prefix = prefix_hash(mix64(chars.astype(np.uint64) + np.uint64(1)))
    m = n - gram + 1
    # each sum is brought back to the base's power 0, so that a hash names its characters alone
    hashes = mix64((prefix[gram:] - prefix[:m]) * powers(m, INVERSE))
    if m <= 1:
        return hashes, np.zeros(m, np.int64)
    window = min(window, m)
    low, at = hashes, np.arange(m, dtype=np.int32)
    width = 1
    while width < window:  # rightmost minima over twice the width, or what is left of it
        step = min(width, window - width)
        right = low[step:] <= low[:-step]
        low = np.where(right, low[step:], low[:-step])
        at = np.where(right, at[step:], at[:-step])
        width += step
    first = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=first[1:])
    at = at[first].astype(np.int64)
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two kept-hash sets (1 for two empty ones)."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A name for a fingerprint: equal for equal kept hashes and positions."""
    return hashlib.sha256(hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes, positions of every whole text (null: empty).
    Repeated rows stay; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                chars = code_points(text)
                h, at = fingerprint(chars, gram, window)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(chars)], pa.int64()), pa.array([h.view(np.int64)], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.int64()))], ["doc_id", "n_chars", "hashes", "positions"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def with_neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Numbers the rows' ranges (bucket) in the order of doc_id, then hash (which
    parts the rows of a doc_id that has very many); the first row of each range
    also goes to the range before it (that of the first to the last), marked *extra*.
    Rows are distinct. What reaches the driver and the tasks is two numbers for each
    range, whose number is set, not the data's."""
    docs = docs.select("text", F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("d"), "h", "doc_id", "times")
    marks = np.sort(np.array(docs.stat.approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.5 / ranges) if ranges > 1 else [], np.float64))
    marks = marks.clip(-(2.0**63), 2.0**63 - 1025).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(d: pd.Series, h: pd.Series) -> pd.Series:
        d, h = d.to_numpy(np.int64), h.to_numpy(np.int64)
        low, high = np.searchsorted(marks, d, "left"), np.searchsorted(marks, d, "right")
        part = ((h / 2.0**64 + 0.5) * (high - low + 1)).astype(np.int64)
        return pd.Series((low + np.minimum(part, high - low)).astype(np.int32))

    placed = docs.withColumn("own", bucket_of("d", "h"))
    begins = placed.groupBy("own").agg(F.min(F.struct("d", "h")).alias("f")).orderBy("own").collect()  # at most a row for each range
    if not begins:
        return docs.select("doc_id", "h", "text", "times", F.lit(0).alias("bucket"), F.lit(False).alias("extra"))
    at = np.array([(r["f"]["d"], r["f"]["h"]) for r in begins], [("d", np.int64), ("h", np.int64)])
    before = np.array([begins[i - 1]["own"] for i in range(len(begins))], np.int32)
    own_of = {int(r["own"]): i for i, r in enumerate(begins)}

    @F.pandas_udf("int")
    def prior_of(own: pd.Series, d: pd.Series, h: pd.Series) -> pd.Series:
        i = own.map(own_of).to_numpy(np.int64)
        first = (at["d"][i] == d.to_numpy(np.int64)) & (at["h"][i] == h.to_numpy(np.int64))
        return pd.Series(np.where(first, before[i], -1))

    spread = placed.withColumn("prior", prior_of("own", "d", "h"))
    one = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra"))
    rows = F.when(F.col("prior") < 0, F.array(one)).otherwise(F.array(one, F.struct(F.col("prior").alias("bucket"), F.lit(True).alias("extra"))))
    return spread.select("doc_id", "h", "text", "times", F.explode(rows).alias("r")).select("doc_id", "h", "text", "times", "r.bucket", "r.extra")


def edited_likeness(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and their
    likeness; and the likeness to the next document's fingerprint.

    The edited text has the last quarter (n_chars // 4 code points) replaced by
    the first as many of the next document in ascending doc_id; rows of one doc_id
    go by a hash of their text, equal ones follow one another: all but the last are
    followed by themselves. The first follows the last, a lone document itself. Null
    doc_ids come first, null texts are empty; an empty table gives an empty one.
    Other columns don't matter. Equal rows are one row with a count until they are
    told, so that no task gets them all."""
    base = texts_of(docs).withColumn("h", F.xxhash64("text"))
    ranges = ranges or int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = cut(base.groupBy("doc_id", "h").agg(F.count("*").alias("times")).where("times > 1"), "again")
    if again.isEmpty():
        base = base.withColumn("times", F.lit(1).cast("long"))
    else:
        names = again.select(F.col("doc_id").alias("of"), F.col("h").alias("oh"), "times")
        same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh"))
        base = base.dropDuplicates(["doc_id", "h"]).join(names, same, "left").select("doc_id", "text", "h", F.coalesce("times", F.lit(1)).cast("long").alias("times"))
    # a bucket is a task: its number is the partition's
    dealt = with_neighbours(base, ranges).repartitionById(ranges, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "h")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long, times long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cols = [batch.column(c) for c in ("doc_id", "text", "times", "bucket", "extra")]
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in cols)

        def made():
            prior = None
            done = None  # the bucket whose last row has been followed
            for doc, text, times, bucket, extra in rows():
                if extra and done == bucket:
                    continue
                chars = code_points(text)
                kept = fingerprint(chars, gram, window)
                if prior is not None and prior[3] == bucket:
                    yield compare(prior, chars, kept, 1)
                if times > 1 and not extra:
                    yield compare((doc, chars, kept, bucket), chars, kept, times - 1)
                prior = None if extra else (doc, chars, kept, bucket)
                done = bucket if extra else None

        def compare(prior, after, after_kept, times):
            doc, chars, kept, _ = prior
            n = len(chars) // 4
            new = np.concatenate([chars[: len(chars) - n], after[:n]])
            new_kept = fingerprint(new, gram, window)
            edited = new.astype("<u4").tobytes().decode("utf-32-le")
            return doc, len(chars), hashlib.sha256(edited.encode()).hexdigest(), digest(*kept), digest(*new_kept), likeness(kept[0], new_kept[0]), likeness(kept[0], after_kept[0]), len(kept[0]), times

        held = []
        for row in made():
            held.append(row)
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    told = dealt.mapInArrow(run, schema)
    if again.isEmpty():
        return told.drop("times")
    # equal rows are told as often as they are; a chunk is a row until it has moved
    chunks = told.withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK))))
    spread = chunks.withColumn("times", F.least(F.lit(CHUNK), F.col("times") - F.col("left") * CHUNK)).drop("left").repartition(ranges)
    return spread.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
