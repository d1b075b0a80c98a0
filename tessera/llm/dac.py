"""Token-id files of directly addressable codes.

An id is cut into chunks, lowest first, one chunk a level.  A level holds the
chunks of the ids that reach it and a bitmap that says which of them go on;
a directory of counts makes rank on that bitmap a constant-time step, so any
token is read with one byte probe a level and no block is decoded.

File layout, little-endian: magic ``DAC1``, uint32 header size, JSON header
(section name -> [offset, count, dtype], widths, n_tokens, n_docs), sections."""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import TOKEN_STEP, cut, dealt, hadoop_path, ragged, shared_path, steps, texts_of
from tessera.llm.segments import WordPairs

MAGIC = b"DAC1"
#: Bits of each level's chunk; the last is wide enough for any 32-bit id.
WIDTHS = (8, 8, 16)
#: Bits of bitmap a directory entry covers.
RANK_BITS = 512
#: Tokens a file holds, unless one document has more.
SHARD_TOKENS = 4_000_000
END_ID = 2
MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_CHUNK = {8: np.uint8, 16: np.uint16}


def encode(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, widths: tuple[int, ...] = WIDTHS, named: np.ndarray | None = None) -> bytes:
    """The bytes of one file: *starts* has an entry more than *doc_ids*; *named*
    says which documents have an id, if not all do."""
    sections: dict[str, np.ndarray] = {"doc_ids": np.asarray(doc_ids, "<i8"), "starts": np.asarray(starts, "<i8")}
    if named is not None and not named.all():
        sections["named"] = np.asarray(named, np.uint8)
    rest = np.asarray(ids, np.uint32)
    for level, width in enumerate(widths):
        sections[f"chunk{level}"] = (rest & np.uint32((1 << width) - 1)).astype(_CHUNK[width])
        rest = rest >> np.uint32(width)
        more = rest > 0
        if level + 1 < len(widths):
            bits = np.packbits(more, bitorder="little")
            step = RANK_BITS // 8
            padded = np.zeros(-(-max(len(bits), 1) // step) * step, np.uint8)
            padded[: len(bits)] = bits
            ones = _POPCOUNT[padded].reshape(-1, step).sum(1, dtype=np.int64)
            sections[f"bits{level}"] = padded
            sections[f"rank{level}"] = (np.cumsum(ones) - ones).astype("<i8")
        rest = rest[more]
    if len(rest):
        raise ValueError("an id needs more bits than the levels have")
    place, at = {}, 0
    for name, x in sections.items():
        place[name] = [at, len(x), np.dtype(x.dtype).str]
        at += -(-x.nbytes // 8) * 8
    head = json.dumps({"sections": place, "widths": list(widths), "n_tokens": len(ids), "n_docs": len(doc_ids)}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    out = [MAGIC, len(head).to_bytes(4, "little"), head]
    for x in sections.values():
        out += [x.tobytes(), bytes(-x.nbytes % 8)]
    return b"".join(out)


class Reader:
    """Reads a file's bytes; only what is asked for is touched, so *data* may be
    a memory map."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a directly-addressable-codes file")
        size = int.from_bytes(view[4:8], "little")
        head = json.loads(bytes(view[8 : 8 + size]))
        self.n_tokens, self.n_docs, self.widths = head["n_tokens"], head["n_docs"], tuple(head["widths"])
        section = lambda s: np.frombuffer(view, np.dtype(s[2]), s[1], 8 + size + s[0])
        self._at = {k: section(s) for k, s in head["sections"].items()}
        self.doc_ids, self.starts = self._at["doc_ids"], self._at["starts"]
        #: Which documents have an id; an absent section says all.
        self.named = self._at["named"].view(bool) if "named" in self._at else np.ones(self.n_docs, bool)

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap."""
        block = i // RANK_BITS
        bits = self._at[f"bits{level}"]
        n = int(self._at[f"rank{level}"][block]) + int(_POPCOUNT[bits[block * RANK_BITS // 8 : i // 8]].sum())
        return n + (bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def token(self, i: int) -> int:
        """The i-th id of the file, without decoding any other."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, width in enumerate(self.widths):
            value |= int(self._at[f"chunk{level}"][i]) << shift
            shift += width
            if level + 1 == len(self.widths) or not self._at[f"bits{level}"][i // 8] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return value

    def tokens(self) -> np.ndarray:
        """All ids, level by level."""
        out = self._at["chunk0"].astype(np.uint32)
        at, shift = np.arange(self.n_tokens), 0
        for level, width in enumerate(self.widths[:-1]):
            shift += width
            n = len(self._at[f"chunk{level}"])
            at = at[np.unpackbits(self._at[f"bits{level}"], count=n, bitorder="little").view(bool)]
            out[at] |= self._at[f"chunk{level + 1}"].astype(np.uint32) << np.uint32(shift)
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, without decoding any other: codes that go
        on at a level lie together there, from the rank of the first bit on."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        out = self._at["chunk0"][start:end].astype(np.uint32)
        at, shift = np.arange(len(out)), 0
        for level, width in enumerate(self.widths[:-1]):
            if not len(at):
                break
            shift += width
            first = start // 8
            more = np.unpackbits(self._at[f"bits{level}"][first : -(-end // 8)], bitorder="little")[start - 8 * first : end - 8 * first].view(bool)
            at = at[more]
            start = self.rank(level, start) if len(at) else 0
            end = start + len(at)
            out[at] |= self._at[f"chunk{level + 1}"][start:end].astype(np.uint32) << np.uint32(shift)
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by direct access."""
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def _files(path: str):
    """(pyarrow file system, path in it) of a path with a scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the cluster's own file system, if it has none."""
    files, p = hadoop_path(spark, path)
    return files.makeQualified(p).toString()


def _commit(path: str, data: bytes) -> None:
    """Writes under another name and renames, so that a file is whole or absent
    and a second attempt of the same task leaves the same file."""
    files, at = _files(path)
    files.create_dir(posixpath.dirname(at), recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, at)


def write_tokens(docs: DataFrame, folder: str, end_id: int | None = END_ID, vocabulary_folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes all documents and writes them in ascending doc_id order (rows
    without one first, rows of one doc_id by text) to files below *folder*; gives the manifest, in which
    (part, shard) is the order. Null text is empty. Lazy: the files exist once
    the result has been computed; rows are dealt out by ranges of doc_id."""
    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordPairs(vocabulary_folder)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs_held: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        count, shard = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal count, shard
            sizes = np.concatenate(lengths)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            path = f"{folder}/part-{part:06d}-{shard:06d}.dac"
            own = pa.concat_arrays(docs_held)  # nulls are kept apart: as floats, ids would lose digits
            _commit(path, encode(np.concatenate(held), own.fill_null(0).to_numpy(), starts, named=own.is_valid().to_numpy(zero_copy_only=False)))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "n_docs": len(sizes), "n_tokens": int(starts[-1])}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            held.clear(), docs_held.clear(), lengths.clear()
            count, shard = 0, shard + 1
            return row

        for batch in batches:
            for piece in steps(batch, limit=TOKEN_STEP):
                ids, ends = encoder.encode(piece.column("text"))
                sizes = np.diff(ends)
                if end_id is not None:
                    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
                    out[ragged(ends[:-1] + np.arange(len(sizes)), sizes)] = ids
                    ids, sizes = out, sizes + 1
                held.append(ids), lengths.append(sizes)
                docs_held.append(piece.column("doc_id"))
                count += len(ids)
                if count >= shard_tokens:
                    yield flush()
        if lengths:
            yield flush()

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, MANIFEST)


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest back, each document by direct access: doc_id,
    start (ids of all documents before it), n_tokens, ids_crc32 (and ids). The
    sizes of files are summed within each part, and those of the parts, a row for
    each task that wrote, in their order; none of it reaches the driver. Documents
    without a doc_id have none here. No files, no rows."""
    parts = manifest.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("of", (F.sum("n").over(Window.orderBy("of")) - F.col("n")).alias("earlier"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    files = manifest.withColumn("within", within).join(parts, F.col("part") == F.col("of")).select("path", (F.col("earlier") + F.col("within")).alias("before"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                store, at = _files(path)
                with store.open_input_file(at) as f:
                    reader = Reader(f.read())
                ids, starts = [reader.document(k).astype("<u4") for k in range(reader.n_docs)], reader.starts
                cols = [pa.array(reader.doc_ids, mask=~reader.named), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return dealt(files, "path").mapInArrow(read, schema)


def token_output(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes and reads back: the whole round trip through the file format. Null
    texts are empty; documents without a doc_id come first and keep none; repeated
    rows are documents of their own; an empty table gives an empty one; other
    columns don't matter."""
    spark = docs.sparkSession
    manifest = cut(write_tokens(docs, folder or shared_path(spark, "tokens"), **options), "manifest")
    return read_tokens(spark, manifest)
