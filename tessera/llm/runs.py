"""Runs of repeated words: stretches that have a period.

A run of period q and three times that length or more holds an aligned block of
the greatest power of two up to q (8 at least) that occurs again q words further
on.  At each scale the blocks of a document become integer keys of an
Aho-Corasick automaton (sequences of names of their parts, which are named by
doubling) and are searched across it; an occurrence at a distance
from the block's size to twice that seeds a stretch, which is extended both ways
while words at that distance agree.  Of equal stretches the least distance is the
period.  Only words that come again within the scale's distance can lie in a run,
so that parts of a document without enough of them in a row are passed over."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import mix64, powers, prefix_hash, ragged, steps, texts_of
from tessera.llm.words import within, words_of

#: A run has so many words, and so many periods, at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: The least block: with it, the run's first 2 * BASE - 1 words and a period up to
#: BASE fit in MIN_WORDS, so that a block and its next occurrence lie in the run.
BASE = 8
FAR = np.iinfo(np.int64).max

#: Given (doc_ids, words of each document by its first and one end more), the word
#: of the slice that stands at each place.
Arrange = Callable[[list, np.ndarray], np.ndarray]


def distances(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far before each word the same word last stood in its document."""
    keys = within(hashes, doc)
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    out = np.full(len(keys), FAR)
    out[order[1:][again]] = (order[1:] - order[:-1])[again]
    return out


def regions(near: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Parts [low, high) of a document that may hold runs of periods from *block*
    to twice that: *near* says which words come again."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < 2 * block:
            continue
        low = max(a - 2 * block + 1, 0)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((low, b))
    return out


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of all windows of twice the width, from the names of those of *width*
    words: equal for equal windows only."""
    if len(names) <= width:
        return names[:0]
    pairs = names[:-width].astype(np.int64) * (int(names.max()) + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1]


def seeds(names: np.ndarray, low: int, high: int, block: int, blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(place, distance) of the aligned blocks, which begin at *blocks*, that occur
    again in [low, high) at a distance of the scale. A key is the names of a block's
    BASE parts, so that no key is long; each way to part the text is searched."""
    width = block // BASE
    places: dict[tuple, list[int]] = {}
    for x in blocks:
        places.setdefault(tuple(names[x : x + block : width].tolist()), []).append(x)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, at in places.items():
        automaton.add_word(key, at)
    automaton.make_automaton()
    least = 1 if block == BASE else block
    for start in range(low, low + width):
        parts = tuple(names[start : high - width + 1 : width].tolist())
        for end, at in automaton.iter(parts) if len(parts) >= BASE else ():
            y = start + (end - BASE + 1) * width
            for x in at[bisect_right(at, y - 2 * block) : bisect_left(at, y - least + 1)]:
                yield x, y - x


def _reach(sums: np.ndarray, at: np.ndarray, d: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from *at* (backwards, if step is -1) agree with those d
    further on, by binary search on sums of hashes: never too few."""
    factor = powers(len(sums))[d]
    low, high = np.zeros(len(at), np.int64), room + 1
    while (open_ := high - low > 1).any():
        m = np.where(open_, (low + high) // 2, low)
        to = at + step * m
        same = (sums[to] - sums[at]) * factor == sums[to + d] - sums[at + d]
        low, high = np.where(same & open_, m, low), np.where(same | ~open_, high, m)
    return low


def _grown(codes: np.ndarray, x: int, d: int) -> tuple[int, int]:
    """The stretch of distance d around x, word by word."""
    same = codes[:-d] == codes[d:]
    before, after = np.flatnonzero(~same[:x]), np.flatnonzero(~same[x:])
    return (int(before[-1]) + 1 if len(before) else 0), (x + int(after[0]) if len(after) else len(same)) + d


def runs_of(codes: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, by start and
    period; *last* has each word's distance to the same word before."""
    n = len(codes)
    found: dict[tuple[int, int], int] = {}
    block, names, sums = BASE, codes, None
    # Where the furthest run around a word ends. A block and its next occurrence that
    # lie in one run, of a period up to the block's size, seed that run again.
    covered = np.zeros(n, np.int64)
    while n >= max(MIN_WORDS, MIN_PERIODS * block):
        fresh: list[tuple[int, int]] = []
        for low, high in regions(last < 2 * block, block):
            blocks = [x for x in range(-(-low // block) * block, high - block + 1, block) if covered[x] < min(x + 3 * block - 1, high)]
            pairs = np.array(list(seeds(names, low, high, block, blocks)), np.int64).reshape(-1, 2) if blocks else np.zeros((0, 2), np.int64)
            pairs = pairs[covered[pairs[:, 0]] < pairs.sum(1) + block]
            if not len(pairs):
                continue
            if sums is None:
                sums = prefix_hash(mix64(codes.astype(np.uint64) + np.uint64(1)))
            x, d = pairs[:, 0], pairs[:, 1]
            left, right = x - _reach(sums, x, d, x, -1), x + _reach(sums, x, d, n - d - x, 1) + d
            long = right - left >= np.maximum(MIN_WORDS, MIN_PERIODS * d)
            for p, a, b, s in np.unique(np.stack([d, left, right, x], 1)[long], axis=0).tolist():
                if (a, b) in found:
                    continue
                if not np.array_equal(codes[a : b - p], codes[a + p : b]):  # the sums agreed by chance
                    a, b = _grown(codes, s, p)
                    if (a, b) in found or b - a < max(MIN_WORDS, MIN_PERIODS * p):
                        continue
                found[a, b] = p
                fresh.append((a, b))
        for a, b in fresh:
            np.maximum(covered[a:b], b, out=covered[a:b])
        names = doubled(names, block // BASE)
        block *= 2
    return sorted((a, b - a, p) for (a, b), p in found.items())


def _stronger(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    return b[1] * a[2] - a[1] * b[2]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of runs by start and period, the first of those with the greatest exact
    length / period."""
    return min(runs, key=cmp_to_key(_stronger)) if runs else None


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:long,length:long,period:long>"


def periodic_runs(docs: DataFrame, arrange: Arrange | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then
    period), strongest (the one of most periods; ties: the first) and text (the
    words that no run repeats: of each run the first period stays, joined by one
    space) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A null or empty text, or
    one without words, has no runs, no strongest run and an empty text; repeated
    rows stay; an empty table gives an empty one; other columns don't matter.
    *arrange* puts other words of the documents in their places first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                w = words_of(part.column("text"))
                n = len(w.starts)
                place = np.arange(n) if arrange is None else arrange(part.column("doc_id").to_pylist(), w.doc_start)
                hashes = w.hashes()[place]
                doc = np.repeat(np.arange(part.num_rows), np.diff(w.doc_start))
                last = distances(hashes, doc)
                # without so many near words in a row, no scale has a region
                widest = np.zeros(part.num_rows, np.int64)
                some = last < FAR
                edges = np.flatnonzero(np.diff(np.concatenate([[0], some.view(np.int8), [0]])))
                if len(edges):
                    np.maximum.at(widest, doc[edges[::2]], edges[1::2] - edges[::2])
                stay = np.ones(n, bool)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(widest >= 2 * BASE):
                    a, b = w.doc_start[i], w.doc_start[i + 1]
                    _, codes = np.unique(hashes[a:b], return_inverse=True)
                    runs[i] = runs_of(codes, last[a:b])
                    gone = np.zeros(b - a + 1, np.int64)
                    for s, length, p in runs[i]:
                        gone[s + p] += 1
                        gone[s + length] -= 1
                    stay[a:b] = np.cumsum(gone[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(w.doc_start)), _lists(runs), pa.array([dict(zip(("start", "length", "period"), r)) if r else None for r in map(strongest, runs)], _RUN), _joined(w, place[stay], doc[stay], part.num_rows)],
                    ["doc_id", "n_words", "runs", "strongest", "text"],
                )

    return texts_of(docs).mapInArrow(run, f"doc_id long, n_words long, runs array<{_RUN_SQL}>, strongest {_RUN_SQL}, text string")


def _lists(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    ends = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))


def _joined(w, place: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.Array:
    """Words (which lie in *doc*, ascending) of each document, joined by spaces."""
    sizes = w.ends[place] - w.starts[place] + 1  # with the white space that follows each word
    data = w.data[ragged(w.starts[place], sizes)]
    data[np.cumsum(sizes) - 1] = 32
    total = np.bincount(doc, weights=sizes, minlength=n_docs).astype(np.int64)
    ends = np.cumsum(total)
    last = ends[total > 0] - 1  # the space after each document's last word
    data = np.delete(data, last)
    ends = np.concatenate([[0], np.cumsum(np.maximum(total - 1, 0))]).astype(np.int32)
    return pa.StringArray.from_buffers(n_docs, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
