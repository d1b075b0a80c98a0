"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most *capacity* tokens; the plan that packs them
is made on the histogram of piece lengths alone, whose size is the capacity and
never grows with the corpus.  The plan looks up single, pair and triple length
sums that fill a gap exactly, under the counts that are left, and packs what
remains best-fit in descending order.  Pieces are then numbered within their
length and read their place from the plan."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import aside, TOKEN_STEP, cut, steps, texts_of
from tessera.llm.segments import BytePairs

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    out = [(0, first)] if n else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


class Complements:
    """Lengths that fill a gap exactly, found by their sum.

    Singles are indexed by length, pairs by the sum of two lengths (the longer
    ones in descending order), triples by the sum of a third length and of a pair
    that is in the index. An entry is good while the counts have its lengths; as
    counts only fall, one that has run out is passed over for good."""

    def __init__(self, left: np.ndarray):
        self.left = left
        capacity = len(left) - 1
        present = np.flatnonzero(left)[::-1]
        there = left > 0
        self.pairs: list[np.ndarray] = [np.zeros(0, np.int64)] * (capacity + 1)
        for total in range(2, capacity + 1):
            longer = present[(present < total) & (2 * present >= total)]
            self.pairs[total] = longer[there[total - longer]]
        self.first_pair = [0] * (capacity + 1)
        self.triples: dict[int, np.ndarray] = {}
        self.first_triple: dict[int, int] = {}

    def _has(self, lengths: tuple[int, ...], used: tuple[int, ...] = ()) -> bool:
        return all(self.left[x] >= lengths.count(x) + used.count(x) for x in set(lengths))

    def single(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if gap < len(self.left) and self._has((gap,), used) else None

    def pair(self, gap: int, used: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        """The pair of this sum with the longest first length up to *most*."""
        entries, at = self.pairs[gap], self.first_pair[gap]
        while at < len(entries) and not self._has((int(entries[at]), int(gap - entries[at]))):
            at += 1
        self.first_pair[gap] = at
        for a in entries[at:].tolist():
            if a <= most and self._has((a, gap - a), used):
                return a, gap - a
        return None

    def triple(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """The triple of this sum with the longest third length."""
        if gap not in self.triples:
            third = np.flatnonzero(self.left)[::-1]
            third = third[(third <= gap - 2) & (3 * third >= gap)]
            self.triples[gap] = np.array([c for c in third if len(self.pairs[gap - c])], np.int64)
            self.first_triple[gap] = 0
        entries, at = self.triples[gap], self.first_triple[gap]
        while at < len(entries) and not (self.left[entries[at]] and self.pair(int(gap - entries[at]), (), len(self.left))):
            at += 1
        self.first_triple[gap] = at
        for c in entries[at:].tolist():
            if self._has((c,), used) and (two := self.pair(gap - c, (*used, c), c)):
                return c, *two
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first, and how many sequences take them) that
    use up *counts*, the number of pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        left[length] += n
    index = Complements(left)
    out: list[tuple[tuple[int, ...], int]] = []
    residual: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            gap, used = capacity - length, (length,)
            fill = () if not gap else index.single(gap, used) if gap <= length else None
            if fill is None:
                fill = index.pair(gap, used, length)
            if fill is None:
                fill = index.triple(gap, used)
            if fill is None:
                residual.append((length, int(left[length])))
                left[length] = 0
                continue
            lengths, uses = np.unique(used + fill, return_counts=True)
            n = int((left[lengths] // uses).min())
            left[lengths] -= n * uses
            out.append((tuple(sorted(used + fill, reverse=True)), n))
    out += _best_fit(residual, capacity)
    return out


def _best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counted lengths; sequences alike are kept together."""
    bins: dict[int, list[list]] = {}  # space left -> [lengths, how many]
    for length, n in items:
        while n:
            space = min((s for s in bins if s >= length), default=None)
            if space is None:
                each = capacity // length
                whole, rest = divmod(n, each)
                for k, m in ((each, whole), (rest, 1)):
                    if k and m:
                        bins.setdefault(capacity - k * length, []).append([(length,) * k, m])
                break
            group = bins[space][-1]
            m = min(n, group[1])
            group[1] -= m
            if not group[1]:
                bins[space].pop()
                if not bins[space]:
                    del bins[space]
            bins.setdefault(space - length, []).append([group[0] + (length,), m])
            n -= m
    return [(tuple(g), m) for groups in bins.values() for g, m in groups]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset): pieces
    ranked from that on lie in consecutive sequences at that offset."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            at = rank.get(length, 0)
            rows.setdefault(length, []).append((at, sequence, offset))
            rank[length] = at + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64).reshape(-1, 3) for k, v in rows.items()}


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document. Null text is empty; a document
    without any token has no piece. *with_ids* adds the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairs(folder)
        for batch in batches:
            for part in steps(batch, limit=TOKEN_STEP):
                ids, ends = encoder.encode(part.column("text"))
                rows = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = ids[ends[i] : ends[i + 1]]
                    if end_id is not None:
                        own = np.append(own, np.uint32(end_id))
                    own = np.ascontiguousarray(own, "<u4")
                    for k, (start, length) in enumerate(piece_bounds(len(own), capacity)):
                        x = own[start : start + length]
                        rows.append((doc, k, start, length, zlib.crc32(x), *((x.astype(np.int32),) * with_ids)))
                cols = list(zip(*rows)) or [[]] * (5 + with_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[: len(cols)])

    return texts_of(docs).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length.

    Repeated rows are packed as separate pieces; an empty table gives an empty
    one; extra columns pass through (sequence_id and offset are replaced).
    Pieces of one length are ranked in hashed buckets, so that a length which
    most pieces have (full ones, say) is never sorted in one task."""
    pieces, back = aside(pieces.drop("sequence_id", "offset"))
    salt = "__bucket"
    n = int(pieces.agg(F.count("*")).first()[0])
    buckets = max(8, -(-n // per_bucket))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = salted.groupBy("length", salt).agg(F.count("*").alias("__n"))
    histogram = {int(r["length"]): int(r["n"]) for r in per.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    before = per.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy(salt)) - F.col("__n")).drop("__n")
    order = ["doc_id", "piece"]
    ranked = (
        salted.withColumn("__row", F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)))
        .join(before, ["length", salt])
        .withColumn("__rank", F.col("__before") + F.col("__row") - 1)
        .drop(salt, "__row", "__before")
    )
    keep = pieces.columns
    out = ranked.select(*keep, "__rank")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), table[int(x)]
                i = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows[i, 1] + rank[at] - rows[i, 0], rows[i, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return back(out.mapInArrow(place, schema))


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenises and packs all documents: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset (and ids). Null and empty texts are a piece of the
    end id alone; rows without a doc_id and repeated rows are documents of their own;
    an empty table gives an empty one; other columns don't matter."""
    return pack(cut(tokenised_pieces(docs, capacity, end_id, folder, with_ids), "pieces"), capacity)
