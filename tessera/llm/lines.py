"""Repeated lines across documents.

Every line has a key (its text without white space at both ends, A-Z lowered),
named by 128 bits of its whole content.  The names are dealt out by ranges and
sorted by name, document and position; one pass over a range holds the first
occurrences of a name until its documents are enough, and then lets the lines go.
Ranges are cut by name *and* document, so a line that is in a third of all
documents fills several ranges: what a range's first and last name have there is
settled afterwards, on a few rows a range.  The result has no text but, for each
document that loses lines, a compressed bitmap of those that stay."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, steps, texts_of
from tessera.llm.words import words_of

#: A key in so many documents is repeated; shorter keys (code points) never are.
MIN_DOCS, MIN_CHARS = 10, 1
#: What a row of a range says of its line.
DROPPED, OPEN, ENOUGH = 0, 1, 2

_OCCURRENCE = ["h1", "h2", "doc_id", "row", "n_lines", "at"]


def lines_of(texts: pa.Array, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, text of each keyed line, its number there, its name as
    two 64-bit halves); no nulls in texts. Keys under *min_chars* have no row."""
    w = words_of(texts, lower=True)
    feeds = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([w.offsets[1:] - 1, feeds]))
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    low, high = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    keyed = np.flatnonzero(low < high)
    at, to = w.starts[low[keyed]], w.ends[high[keyed] - 1]
    if min_chars > 1:
        leads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        long = leads[to] - leads[at] >= min_chars
        keyed, at, to = keyed[long], at[long], to[long]
    view = memoryview(np.ascontiguousarray(w.data))
    names = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(at.tolist(), to.tolist())])
    return np.diff(first), doc[keyed], keyed - first[doc[keyed]], np.frombuffer(names, "<i8").reshape(-1, 2)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each keyed line: its name (h1, h2), doc_id, the hash of the row's
    text (row), its lines and the line's number. Equal rows that a step sees
    together count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy()
                row = part.column("row").to_numpy()
                _, once = np.unique(np.rec.fromarrays([known, number, row]), return_index=True)
                part = part.take(pa.array(np.sort(once)))
                n, doc, at, names = lines_of(part.column("text"), min_chars)
                doc_of = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[:, 0]), pa.array(names[:, 1]), part.column("doc_id").take(doc_of), part.column("row").take(doc_of), pa.array(n[doc].astype(np.int32)), pa.array(at.astype(np.int32))], _OCCURRENCE
                )

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, row long, n_lines int, at int")


class Stream:
    """One pass over the sorted occurrences of a range. A name that lies whole in
    the range is settled here. The first and the last may go on in other ranges:
    if they have enough documents, their first occurrence is left open and a mark
    says that they have; if not, all occurrences are left open, which are those
    of fewer documents than are enough."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.held: pa.Table | None = None  # the last name: its occurrences, or the first if it has enough
        self.enough = False  # whether it has
        self.first = True  # whether it is the range's first

    @staticmethod
    def _with(rows: pa.Table, state: np.ndarray) -> pa.Table:
        return rows.append_column("state", pa.array(state.astype(np.int8)))

    def take(self, batch: pa.RecordBatch) -> pa.Table | None:
        """What the next occurrences settle or leave open, but for the last name."""
        rows = pa.Table.from_batches([batch])
        if self.held is not None:
            rows = pa.concat_tables([self.held, rows]).combine_chunks()
        n = rows.num_rows
        if not n:
            return None
        h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
        ids = rows["doc_id"].combine_chunks()
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        starts, others = np.ones(n, bool), np.ones(n, bool)
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        others[1:] = starts[1:] | (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
        lead = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        enough = np.add.reduceat(others.astype(np.int64), lead) >= self.min_docs
        enough[0] |= self.enough
        state = np.where(enough[run], DROPPED, -1)
        state[lead[enough]] = -1 if self.keep_first else DROPPED
        marks = rows.slice(0, 0)
        if self.first and len(lead) > 1:
            state[: 1 if enough[0] else lead[1]] = OPEN
            marks = rows.slice(0, int(enough[0]))
        last = lead[-1]
        state[last if enough[-1] else slice(last, n)] = -1
        self.first = self.first and len(lead) == 1
        self.enough = bool(enough[-1])
        self.held = rows.slice(last, 1 if self.enough else n - last)
        return pa.concat_tables([self._with(rows, state).filter(pa.array(state >= 0)), self._with(marks, np.full(marks.num_rows, ENOUGH))])

    def end(self) -> pa.Table | None:
        """The range's last name."""
        if self.held is None:
            return None
        marks = self.held.slice(0, int(self.enough))
        return pa.concat_tables([self._with(self.held, np.full(self.held.num_rows, OPEN)), self._with(marks, np.full(marks.num_rows, ENOUGH))])


def repeated_lines(found: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, row, n_lines, at) of the lines that go: those whose name is in at
    least *min_docs* doc_ids (rows without one are one document), but the first of
    each by doc_id, if *keep_first*."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc_id", "row", "at"]
    ranges = found.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(min_docs, keep_first)
        for batch in batches:
            out = stream.take(batch)
            if out is not None:
                yield from out.to_batches()
        out = stream.end()
        if out is not None:
            yield from out.to_batches()

    settled = cut(ranges.mapInArrow(run, "h1 long, h2 long, doc_id long, row long, n_lines int, at int, state byte"), "settled")
    gone = settled.where(F.col("state") == DROPPED).select("doc_id", "row", "n_lines", "at")
    left = settled.where(F.col("state") != DROPPED)  # a few rows for each range
    place = F.struct("doc_id", "row", "at")
    names = left.groupBy("h1", "h2").agg(
        F.max("state").alias("top"),
        F.count_distinct(F.struct("doc_id")).alias("docs"),
        F.min(F.when(F.col("state") == OPEN, place)).alias("lead"),
    ).where((F.col("top") == ENOUGH) | (F.col("docs") >= min_docs))
    late = left.where(F.col("state") == OPEN).join(names, ["h1", "h2"])
    if keep_first:
        late = late.where(~F.col("lead").eqNullSafe(place))
    return gone.union(late.select("doc_id", "row", "n_lines", "at"))


def packed(keep: np.ndarray) -> bytes:
    """A bitmap: a byte that says how, then the bits, as they are or by zlib."""
    bits = np.packbits(keep, bitorder="little").tobytes()
    small = zlib.compress(bits)
    return b"\1" + small if len(small) < len(bits) else b"\0" + bits


def unpacked(bitmap: bytes, n: int) -> np.ndarray:
    bits = zlib.decompress(bitmap[1:]) if bitmap[0] else bitmap[1:]
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n, bitorder="little").view(bool)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, text), in which *row* is a hash of the text: it tells rows of
    one doc_id apart."""
    base = texts_of(docs, id_col, text_col)
    return base.select("doc_id", F.xxhash64("text").alias("row"), "text")


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, row, n_lines, n_dropped and keep (a packed bitmap by line) of each
    document that loses lines; the others keep all of theirs.

    A text is split at line feeds; null and empty texts are one empty line. Lines
    are repeated if their keys, of *min_chars* code points or more, are in at least
    *min_docs* documents, however often in each. Rows of one doc_id are one
    document there, as are rows without one, and have a bitmap each; equal rows
    have one together. An empty table gives an empty one. Other columns of *docs*
    don't matter."""
    found = cut(occurrences(keyed(docs), min_chars), "lines")
    gone = repeated_lines(found, min_docs, keep_first)
    sets = gone.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("at"))  # a document's own lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps, n_dropped = [], []
            for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("at")):
                keep = np.ones(n, bool)
                keep[at.values.to_numpy()] = False
                keeps.append(packed(keep))
                n_dropped.append(n - int(keep.sum()))
            n_lines = batch.column("n_lines").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), n_lines, pa.array(n_dropped, pa.int64()), pa.array(keeps, pa.binary())], ["doc_id", "row", "n_lines", "n_dropped", "keep"])

    return sets.mapInArrow(run, "doc_id long, row long, n_lines long, n_dropped long, keep binary")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (the lines that stay, joined by line
    feeds; empty if none does) of every row; see ``keep_bitmaps``. Bitmaps are
    written first, so that Spark broadcasts few and sorts many."""
    base = keyed(docs)
    maps = cut(keep_bitmaps(docs, min_docs, min_chars, keep_first), "bitmaps").select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "n_dropped", "keep")
    joined = base.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                n_lines, texts = [], []
                for text, keep in zip(part.column("text").to_pylist(), part.column("keep").to_pylist()):
                    n_lines.append(text.count("\n") + 1)
                    texts.append(text if keep is None else "\n".join(compress(text.split("\n"), unpacked(keep, n_lines[-1]))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_lines, pa.int64()), part.column("n_dropped"), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")
