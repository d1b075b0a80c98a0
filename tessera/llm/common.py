"""Helpers that the training-data operators share: frames in the shared folder,
column isolation, Arrow slicing, names of contents and byte hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import cut, forget, hadoop_path, shared_path, shared_root, written

__all__ = ["cut", "forget", "hadoop_path", "shared_path", "shared_root", "written"]

#: Bytes of text that one vectorised step looks at, unless one text is longer.
STEP_BYTES = 1_000_000
#: The same for tokenisation, which gains from segments that recur.
TOKEN_STEP = 4_000_000


class Placed:
    """A frame that is written once, dealt out by keys, as a table in the shared
    folder; later joins on all the keys move only their other side."""

    def __init__(self, df: DataFrame, what: str, *keys: str):
        self.spark: SparkSession = df.sparkSession
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"{what}_{uuid.uuid4().hex}", shared_path(self.spark, what)
        df.repartition(n, *keys).write.format("parquet").option("path", self.path).bucketBy(n, *keys).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table off the catalog and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        forget(self.path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in a set number of tasks: by their bytes alone, adaptive
    execution would give few tasks all the work that is done on them."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as keep them off the
    frame's own columns (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(the frame with its columns that begin with two underscores under other names,
    what gives them their names back), as operators make such columns."""
    names = {c: f"aside_{i}_{uuid.uuid4().hex}" for i, c in enumerate(df.columns) if c.startswith("__")}
    return df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_text: str | None = "") -> DataFrame:
    """Only (doc_id, text), under these names, so that no other column of the
    input can clash with what an operator makes. Null texts become *null_text*."""
    text = F.col(f"`{text_col}`").cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def trim() -> None:
    """Gives freed memory back, as Spark keeps its Python workers for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about *limit* bytes together."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets with one more entry than rows) of a text or
    binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of all runs, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a span that are hashed eight at a time; a longer one is hashed by itself.
SHORT = 32


def content_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the whole content of each span [start, end) of *data*."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # eight bytes from each place
    size = ends - starts
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at = np.arange(len(size))
    for k in range(0, SHORT, 8):
        at = at[size[at] > k]
        keep = np.minimum(size[at] - k, 8).astype(np.uint64)
        out[at] = mix64(out[at] ^ words[starts[at] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * keep)))
    view = memoryview(padded)
    for i in at[size[at] > SHORT].tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


#: A 64-bit value for each byte, and an odd base: hashes of short windows are taken
#: of these. Modulo a power of two, some long strings of two letters collide, so
#: these hashes place and sample; none of them decides that contents are equal.
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of codes[j] * BASE**j for j < i, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
