"""Ranked lexical search by WAND over shards of documents.

Documents are cut into shards of bounded size.  A shard has the postings of the
queries' terms: documents, frequencies and lengths.  With the corpus's counts, each
term of a shard has a greatest impact; a query's cursors are kept by document, the
first at which the sums of their terms' greatest impacts reach the threshold is the
pivot, and cursors before it skip to it, so that documents which can't get into the
heap are never scored.  A task carries its heaps from shard to shard, and the heaps
of all tasks are merged.  Queries are taken in blocks of a bounded number of terms,
each of which goes to all tasks."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, content_hashes, cut, forget, int64, steps, texts_of, written

#: Documents that a query returns.
TOP = 10
#: Bytes of text in a shard, unless one document has more.
SHARD_BYTES = 4_000_000
#: Terms of the queries of a block, about: what goes to each task.
BLOCK_TERMS = 500_000
#: Parts in which the tasks' heaps of a query are merged first.
MERGE_PARTS = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = 1 << 62


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit name of each term of texts without nulls, first term of each text and
    one end more): maximal runs of digits, Latin letters and all that isn't ASCII,
    A-Z lowered. A name is a hash of the whole content."""
    texts = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, offsets = bytes_of(texts)
    inside = _TERM[data]
    at = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8)])))  # starts and ends alternate
    starts, ends = at[::2], at[1::2]
    return content_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): how often an item has each term; the rows of an item_id
    are one item. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                names, first = terms_of(part.column("text"))
                item = np.repeat(np.arange(part.num_rows), np.diff(first))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(item)), pa.array(int64(names))], ["item_id", "term"])

    return texts_of(items, "item_id").mapInArrow(run, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("n"))


_SHARD = "n_docs long, n_terms long, terms array<int>, dfs array<long>, docs binary, known binary, sizes binary, posted binary, counts binary"


def shards_of(docs: DataFrame, vocabulary: np.ndarray, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard: documents with a term, terms with repeats, the terms of
    the sorted *vocabulary* that it has (their numbers there), in how many documents
    each is, and as arrays of bytes the documents' ids, whether they have one, their
    sizes, and by term the documents (numbers in the shard) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=shard_bytes):
                names, first = terms_of(part.column("text"))
                sizes = np.diff(first)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                number = np.minimum(np.searchsorted(vocabulary, names), max(len(vocabulary) - 1, 0))
                ours = vocabulary[number] == names if len(vocabulary) else np.zeros(len(names), bool)
                pairs, counts = np.unique(number[ours] * len(sizes) + doc[ours], return_counts=True)
                term, posted = pairs // len(sizes), pairs % len(sizes)
                terms, dfs = np.unique(term, return_counts=True)
                ids = part.column("doc_id")
                row = [int((sizes > 0).sum()), int(sizes.sum()), terms.astype(np.int32), dfs.astype(np.int64)]
                row += [ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), sizes.astype(np.int64).tobytes(), posted.astype(np.int32).tobytes(), counts.astype(np.int64).tobytes()]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in _SHARD.split(", ")])

    return docs.mapInArrow(run, _SHARD)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """A shard's postings with their impacts, and its terms' greatest ones."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["docs"], np.int64).tolist()
        self.known = np.frombuffer(row["known"], bool).tolist()
        sizes, posted, tf = (np.frombuffer(row[k], t) for k, t in (("sizes", np.int64), ("posted", np.int32), ("counts", np.int64)))
        ends = np.cumsum(np.array(row["dfs"], np.int64))
        m = 25 + 75 * sizes * n_docs // max(n_terms, 1)
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[posted])
        self.posted, self.impacts = posted.tolist(), impacts.tolist()
        most = np.maximum.reduceat(impacts, ends - np.array(row["dfs"], np.int64)) if len(ends) else ends
        starts = [0, *ends.tolist()]
        #: term -> (first posting, end, greatest impact)
        self.lists = {t: (starts[i], starts[i + 1], x) for i, (t, x) in enumerate(zip(row["terms"], most.tolist()))}

    def search(self, query: list[tuple[int, int]], heap: list[tuple], top: int) -> int:
        """Puts the best documents of (term, weight times occurrences) into the heap
        of (score, has an id, -id), the least first; gives how many were scored.
        A document whose bound equals the threshold is scored, as it may have the
        smaller id."""
        posted, impacts = self.posted, self.impacts
        cursors = [[posted[s], f * most, s, e, f] for t, f in query if f > 0 and t in self.lists for s, e, most in (self.lists[t],)]
        by_doc = itemgetter(0)
        cursors.sort(key=by_doc)
        threshold = heap[0][0] if len(heap) == top else 1
        scored = 0
        while cursors:
            bound = 0
            for k, c in enumerate(cursors):
                bound += c[1]
                if bound >= threshold:
                    break
            else:
                break
            pivot = c[0]
            if cursors[0][0] == pivot:
                score = 0
                scored += 1
                for c in cursors:
                    if c[0] != pivot:
                        break
                    i = c[2]
                    score += c[4] * impacts[i]
                    c[2] = i = i + 1
                    c[0] = posted[i] if i < c[3] else _END
                entry = (score, True, -self.ids[pivot]) if self.known[pivot] else (score, False, 0)
                if score >= threshold:
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        threshold = heap[0][0]
            else:
                for c in cursors[:k]:
                    if c[0] < pivot:
                        c[2] = i = bisect_left(posted, pivot, c[2], c[3])
                        c[0] = posted[i] if i < c[3] else _END
            cursors.sort(key=by_doc)
            while cursors and cursors[-1][0] == _END:
                cursors.pop()
        return scored


def _block(docs: DataFrame, table: pa.Table, top: int, shard_bytes: int) -> DataFrame:
    """The best documents of one block of items, each with a rank."""
    vocabulary = np.unique(table["term"].to_numpy().view(np.uint64))
    shards, path = written(shards_of(docs, vocabulary, shard_bytes), "shards")
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    counted = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs")).toArrow()  # at most a row for each term of the block
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in zip(counted[0].to_pylist(), counted[1].to_pylist()):
        weights[t] = weight(n_docs, df)
    number = np.searchsorted(vocabulary, table["term"].to_numpy().view(np.uint64))
    queries: dict = {}
    for item, t, f in zip(table["item_id"].to_pylist(), number.tolist(), (weights[number] * table["n"].to_numpy()).tolist()):
        queries.setdefault(item, []).append((t, f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {item: [] for item in queries}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                for item, query in queries.items():
                    shard.search(query, heaps[item], top)
        rows = [(item, -doc if known else None, score) for item, heap in heaps.items() for score, known, doc in heap]
        part = TaskContext.get().partitionId() % MERGE_PARTS
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array([part] * len(rows), pa.int32())], ["item_id", "doc_id", "score", "part"])

    heaps = shards.select("n_docs", "n_terms", "terms", "dfs", "docs", "known", "sizes", "posted", "counts").mapInArrow(run, "item_id long, doc_id long, score long, part int")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    merged = heaps
    for keys in (["item_id", "part"], ["item_id"]):
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    out = cut(merged.select("item_id", "rank", "doc_id", "score"), "ranked")
    forget(path)
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the *top* documents of each item
    with a score above 0, by falling score, then rising doc_id.

    With N documents that have a term, L terms in all of them, n in a document,
    df documents with a term and tf of it in a document, a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))); with m = 25 + 75 n N div L a document
    gets weight * (10^9 tf div (1000 tf + 8 m)) for each occurrence in the item.

    Null, empty and termless texts of documents are never found and don't count in
    N; such items have no rows. Rows of one item_id are one item; rows that repeat a
    doc_id are documents of their own; null doc_ids come after all others of their
    score. An empty table gives an empty one; other columns don't matter. Blocks of
    items that have more than *block_terms* terms, about, are ranked one after
    another; an item is always whole."""
    base = texts_of(docs)
    terms, path = written(query_terms(items), "query_terms")
    n_blocks = max(1, -(-terms.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    out = None
    for k in range(n_blocks):
        found = _block(base, terms.where(block == k).toArrow(), top, shard_bytes)  # bounded by block_terms
        out = found if out is None else out.union(found)
    forget(path)
    return out
