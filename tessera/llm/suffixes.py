"""Exact substring deduplication by difference-cover suffix sorting.

A byte is removed if a string of LENGTH bytes that covers it also starts
earlier (in a smaller doc_id, or earlier in the same document).

Suffixes are distributed by content, so that suffixes with equal LENGTH-byte
prefixes always meet: each window of LENGTH bytes is represented by its smallest
k-gram (its anchor), which depends on the window alone.  Anchors that occur once
in the corpus cannot start a repeat; what is left is gathered by anchor, and
each task sorts the suffixes of its strings with a difference cover of period
three: triples at positions 1 and 2 modulo 3 are sorted and named, the names are
sorted by recursion until they span LENGTH bytes, the remaining suffixes are
sorted by their first byte and the name that follows, the two orders are
merged, and neighbours are compared over LENGTH bytes.  Only suffixes that begin
a whole window are put in order, and of the names those that this asks for.

Exact copies of documents (by SHA-256), and of strings around one anchor (by 128
bits of their content), are reduced to their first occurrence before that.  Strings of an anchor with very many
occurrences are dealt out again by the content of smaller parts of them, which
lie in the same way around the anchor in every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODES, INVERSE, Placed, bytes_of, cut, dealt, int64, mix64, powers, prefix_hash, ragged, steps, texts_of

LENGTH = 100
GRAM = 32
#: Symbols that one suffix sort takes, unless one anchor has more.
BLOCK = 400_000
#: Bytes of text whose anchors are found together: what that takes stays in a core's cache.
STEP = 200_000
#: Occurrences of an anchor beyond which its strings are dealt out in parts that
#: fewer of them share, so that no task gets them all.
HOT = 20_000
PART = 16
#: Symbols of the distinct strings of one anchor, or part, that are sorted together.
#: Beyond that they are taken apart into single windows, whose 128-bit names bring
#: equal ones together without any group in memory.
GROUP = 4_000_000


# --- anchors -----------------------------------------------------------------


class Anchors:
    """Anchors of all windows of some texts: runs of consecutive windows
    (first to last, positions in *data*) that have one anchor (at)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
        gram = min(GRAM, length)
        self.length, self.gram, self.offsets = length, gram, offsets
        self.prefix = prefix_hash(BYTE_CODES[data])
        self.first = self.last = self.at = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        n = len(data)
        if n < length:
            return
        grams = n - gram + 1
        hashes = mix64((self.prefix[gram:] - self.prefix[:grams]) * powers(grams, INVERSE))
        # the upper half of a hash and the position: the least is the leftmost smallest k-gram
        low = hashes >> np.uint64(32) << np.uint64(32) | np.arange(grams, dtype=np.uint64)
        width, window = 1, length - gram + 1
        while width < window:
            step = min(width, window - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        at = low.astype(np.uint32)  # the lower half
        valid = np.zeros(len(at) + 1, bool)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= length:
                valid[a : b - length + 1] = True
        same = np.zeros(len(at) + 1, bool)  # window j goes on with the anchor of j - 1
        same[1:-1] = (at[1:] == at[:-1]) & valid[1:-1] & valid[:-2]
        self.first = np.flatnonzero(valid[:-1] & ~same[:-1])
        self.last = np.flatnonzero(valid[:-1] & ~same[1:])
        self.at = at[self.first].astype(np.int64)
        self.hash = hashes[self.at]
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1


def anchor_hashes(texts: DataFrame, length: int) -> DataFrame:
    """(hash, tkey, times) for each text and anchor hash in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=STEP):
                found = Anchors(*bytes_of(part.column("text")), length)
                tkey = part.column("tkey").to_numpy(zero_copy_only=False)
                order = np.lexsort((found.hash, found.doc))
                h, d = found.hash[order], found.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(int64(h[at])), pa.array(tkey[d[at]]), pa.array(np.diff(np.append(at, len(h))))], ["hash", "tkey", "times"])

    return texts.select("tkey", "text").mapInArrow(run, "hash long, tkey long, times long")


# --- difference-cover suffix sort --------------------------------------------


def _order(key: np.ndarray, top: int) -> np.ndarray:
    """Positions in ascending order of their keys (0 to top - 1); of equal keys, the
    smaller position first. Key and position are sorted as one number, if they fit."""
    bits = len(key).bit_length()
    if top > 1 << 63 - bits:
        return np.argsort(key, kind="stable")
    both = key << bits | np.arange(len(key))
    both.sort()
    return both & (1 << bits) - 1


def _ranks(key: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Dense ranks, from 1, of keys (0 to top - 1), and how many there are."""
    if top <= 4 * len(key):  # a table of all keys is cheaper than a sort
        seen = np.zeros(top, bool)
        seen[key] = True
        rank = np.cumsum(seen)
        return rank[key], int(rank[-1])
    order = _order(key, top)
    new = np.ones(len(key), np.int64)
    ascending = key[order]
    new[1:] = ascending[1:] != ascending[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum())


def _key(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """(integers in the order of tuples, their bound); a column is given with its bound.
    What would be too large to be sorted with a position is replaced by ranks."""
    key, size = columns[0]
    for c, top in columns[1:]:
        if size * top > 1 << 63 - len(key).bit_length():
            key, size = _ranks(key, size)
            size += 1
        key, size = key * top + c, size * top
    return key, size


def suffix_names(text: np.ndarray, length: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Order of all suffixes of *text* (integers from 1), or of those at the *wanted*
    positions (a mask), by their first *length* symbols at least: positions in
    ascending order; ties in any order."""
    n = len(text)
    if n < 3:
        at = range(n) if wanted is None else np.flatnonzero(wanted).tolist()
        return np.array(sorted(at, key=lambda i: text[i:].tolist()), np.int64)
    rank, base = _sample_ranks(text, length, wanted)
    s = np.append(text, [0, 0, 0])
    r = np.append(rank, [0, 0, 0])
    top = int(s.max()) + 1
    zero, one, two = (np.arange(k, n, 3) if wanted is None else np.flatnonzero(wanted[k::3]) * 3 + k for k in range(3))
    # a symbol, then the name of the sampled suffix after it; or two symbols and
    # the name after them. Where names are cut off, each kind is put in the order
    # of its own keys, so that they ascend
    both = np.concatenate([one, zero])
    single, size = _key((s[both], top), (r[both + 1], base))
    of_one, one_of_zero = single[: len(one)], single[len(one) :]
    by = _order(of_one, size)
    one, of_one = one[by], of_one[by]
    both = np.concatenate([two, zero])
    double, size = _key((s[both], top), (s[both + 1], top), (r[both + 2], base))
    of_two, of_zero = double[: len(two)], double[len(two) :]
    by = _order(of_zero, size)
    zero, of_zero, one_of_zero = zero[by], of_zero[by], one_of_zero[by]
    by = _order(of_two, size)
    two, of_two = two[by], of_two[by]
    sample = np.concatenate([one, two])
    sample = sample[_order(r[sample], base)]
    # merge: where each remaining suffix stands among the samples of either kind
    before = np.searchsorted(of_one, one_of_zero) + np.searchsorted(of_two, of_zero)
    out = np.empty(len(zero) + len(sample), np.int64)
    place = before + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(len(out), bool)
    rest[place] = False
    out[rest] = sample
    return out


def _sample_ranks(text: np.ndarray, length: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(ranks of the suffixes at 1 and 2 modulo 3 by their first *length* symbols at
    least, a bound of them): those that the order of the wanted suffixes asks for,
    which are at most two symbols behind them (0 elsewhere)."""
    n = len(text)
    s = np.append(text, [0, 0, 0])
    top = int(s.max()) + 1
    ones = len(range(1, n, 3))
    triple = lambda j: np.concatenate([s[1 + j : n + j : 3], s[2 + j : n + j : 3]])
    names, distinct = _ranks(*_key((triple(0), top), (triple(1), top), (triple(2), top)))
    if distinct < len(names) and length > 3:
        # the names of one kind, an end mark below all names, those of the other
        deeper = np.concatenate([names[:ones] + 1, [1], names[ones:] + 1])
        asked = None
        if wanted is not None:
            near = wanted.copy()
            near[1:] |= wanted[:-1]
            near[2:] |= wanted[:-2]
            asked = np.concatenate([near[1::3], [False], near[2::3]])
        order = suffix_names(deeper, -(-length // 3), asked)
        place = np.zeros(len(deeper), np.int64)
        place[order] = _tied(deeper, order, -(-length // 3))
        names = np.concatenate([place[:ones], place[ones + 1 :]])
        distinct = int(names.max())
    rank = np.zeros(n, np.int64)
    rank[1::3], rank[2::3] = names[:ones], names[ones:]
    return rank, distinct + 1


def _tied(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Ranks in order, equal where neighbours agree over *length* symbols."""
    s = np.append(text, np.zeros(length, text.dtype))
    differ = np.zeros(len(order), bool)
    differ[:1] = True
    open_ = np.arange(1, len(order))
    left, right = order[:-1], order[1:]
    for j in range(length):
        if not len(open_):
            break
        d = s[right + j] != s[left + j]
        if d.any():
            differ[open_[d]] = True
            same = ~d
            open_, left, right = open_[same], left[same], right[same]
    return np.cumsum(differ)


def window_classes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, position in *data*) of every window of *length* bytes of the strings
    that the offsets bound; windows with equal bytes have one class, numbered from 0
    in ascending order."""
    sizes = np.diff(offsets)
    seen = np.zeros(256, bool)
    seen[data] = True
    # bytes in their order from 2 on, and a mark (1) behind each string: what stands
    # there decides nothing, as only windows that lie in a string are asked for
    codes = np.cumsum(seen) + 1
    behind = np.repeat(np.arange(len(sizes)), sizes + 1)  # marks before each symbol
    within = np.ones(len(behind), bool)
    within[offsets[1:] + np.arange(len(sizes))] = False
    text = np.ones(len(behind), np.int64)
    text[within] = codes[data]
    wanted = np.zeros(len(text), bool)
    wanted[ragged(offsets[:-1] + np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))] = True
    order = suffix_names(text, length, wanted)
    order -= behind[order]
    if not len(order):
        return order, order
    # neighbours are compared over the whole length, eight bytes at a time
    raw = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    same = np.ones(len(order) - 1, bool)
    for j in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
        here = (words if length >= 8 else raw)[order + j]
        same &= here[1:] == here[:-1]
    return np.concatenate([[0], np.cumsum(~same)]), order


def equal_windows(strings: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a list of strings: (class, string, start in it)."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings], dtype=np.int64)])
    group, at = window_classes(np.concatenate(strings), offsets, length)
    which = np.searchsorted(offsets, at, side="right") - 1
    return group, which, at - offsets[which]


# --- the operator ------------------------------------------------------------


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) runs covered by windows at ascending starts."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length) + 1
    a = starts[np.concatenate([[0], gap])]
    return a, starts[np.concatenate([gap - 1, [len(starts) - 1]])] + length


_STRINGS = "key long, c long, e long, doc_id long, tkey long, start long, windows long, lead boolean"
_SPANS = "doc_id long, tkey long, start long, end long"


def _strings(hit: DataFrame, length: int) -> DataFrame:
    """The strings around repeated anchors: where they lie, their name (c and e: 128
    bits of their content, which decides the key) and whether the name is new in the
    text (lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=STEP):
                data, offsets = bytes_of(part.column("text"))
                found, view = Anchors(data, offsets, length), memoryview(data)
                # an anchor that is repeated is so in every text that has it
                hashes, one = np.unique(part.column("hashes").flatten().to_numpy(), return_index=True)
                counts = part.column("counts").flatten().to_numpy()[one]
                own = found.hash.view(np.int64)
                i = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                ok = hashes[i] == own
                d, first, last, at, key, many = (x[ok] for x in (found.doc, found.first, found.last, found.at, own, counts[i]))
                if (many > HOT).any():
                    # parts are blocks of distances from window to anchor, which a window alone decides
                    step = np.where(many > HOT, PART, 1 << 40)
                    pieces = (at - first) // step - (at - last) // step + 1
                    within = ragged(np.zeros(len(pieces), np.int64), pieces)
                    d, first, last, at, key, step = (np.repeat(x, pieces) for x in (d, first, last, at, key, step))
                    block = (at - first) // step - within
                    near, far = block * step, block * step + step - 1
                    first, last = np.maximum(first, at - far), np.minimum(last, at - near)
                    # the bytes that all windows of the block would share, and the block, name it
                    split = np.flatnonzero(step < 1 << 40)
                    a, b = (at - near)[split], (at - np.minimum(far, length - found.gram) + length)[split]
                    core = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(split))
                    key[split] = mix64(core ^ key[split].view(np.uint64) + block[split].astype(np.uint64)).view(np.int64)
                named = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())])
                c, e = np.frombuffer(named, "<i8").reshape(-1, 2).T
                order = np.lexsort((c, d))
                lead = np.ones(len(d), bool)
                lead[order[1:]] = (d[order[1:]] != d[order[:-1]]) | (c[order[1:]] != c[order[:-1]]) | (e[order[1:]] != e[order[:-1]])
                doc_id, tkey = (part.column(x).to_numpy()[d] for x in ("doc_id", "tkey"))
                cols = [key, c, e, doc_id, tkey, first - offsets[d], last - first + 1]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in cols), pa.array(lead)], [x.split()[0] for x in _STRINGS.split(", ")])

    return hit.mapInArrow(run, _STRINGS)


def _contents(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted strings (key, start, windows) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, offsets = bytes_of(part.column("text"))
                strings = part.column("strings")
                of = np.repeat(np.arange(part.num_rows), strings.value_lengths().to_numpy())
                key, start, windows = (x.to_numpy() for x in strings.flatten().flatten())
                doc_id, tkey = (part.column(x).to_numpy()[of] for x in ("doc_id", "tkey"))
                sizes = windows - 1 + length
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes) >> 25, prepend=0, append=-1))
                for a, b in zip(np.append(0, cuts[:-1]), cuts):  # 32 MB at most, as a text may have some times its size in strings
                    bytes_ = data[ragged(offsets[of[a:b]] + start[a:b], sizes[a:b])]
                    ends = np.append(0, np.cumsum(sizes[a:b])).astype(np.int32)
                    content = pa.Array.from_buffers(pa.binary(), int(b - a), [None, pa.py_buffer(ends), pa.py_buffer(bytes_)])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[a:b]) for x in (key, doc_id, tkey, start)), content], ["key", "doc_id", "tkey", "start", "content"])

    return wanted.mapInArrow(run, "key long, doc_id long, tkey long, start long, content binary")


def _sorted_groups(strings: DataFrame, length: int) -> DataFrame:
    """Spans of the windows of distinct strings that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            rows = pa.Table.from_batches(held)
            data, offsets = bytes_of(rows.column("content"))
            doc_id, tkey, at = (rows.column(c).to_numpy() for c in ("doc_id", "tkey", "start"))
            group, pos = window_classes(data, offsets, length)
            repeated = np.zeros(len(data), bool)
            if len(group):
                # the first of each class by document and place in it
                which = np.repeat(np.arange(len(doc_id)), np.diff(offsets))[pos]
                place = np.unique(doc_id, return_inverse=True)[1][which] << 40 | at[which] + pos - offsets[which]
                first = np.minimum.reduceat(place, np.flatnonzero(np.diff(group, prepend=-1)))
                repeated[pos[place != first[group]]] = True
            pos = np.flatnonzero(repeated)
            which = np.searchsorted(offsets, pos, side="right") - 1
            new = np.ones(len(pos), bool)
            new[1:] = (which[1:] != which[:-1]) | (pos[1:] != pos[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(pos))[: len(a)] - 1  # none if no window is repeated
            which, shift = which[a], (at - offsets[:-1])[which[a]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc_id[which], tkey[which], pos[a] + shift, pos[b] + shift + length)], ["doc_id", "tkey", "start", "end"])

        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            before = bytes_of(batch.column("content"))[1]
            begins = np.flatnonzero(np.append(last is not None and key[0] != last, key[1:] != key[:-1]))
            a = 0
            for b in begins.tolist():
                if size + before[b] - before[a] > BLOCK:
                    yield flush([*held, batch.slice(a, b - a)])
                    held, size, a = [], 0, b
            held.append(batch.slice(a))
            size += before[-1] - before[a]
            last = key[-1]
        if held:
            yield flush(held)

    rows = dealt(strings.select("key", "doc_id", "tkey", "start", "content"), "key").sortWithinPartitions("key", "doc_id", "start")
    return rows.mapInArrow(run, _SPANS)


def _named_windows(strings: DataFrame, length: int) -> DataFrame:
    """The same for strings whose anchor has too many: each window has a name of 128
    bits, and the first of each name is found by a minimum, combined before it is
    moved. Windows in a row make one span."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "content"):
                data, offsets = bytes_of(part.column("content"))
                view, sizes = memoryview(data), np.diff(offsets) - length + 1
                at = ragged(offsets[:-1], sizes)
                names = b"".join([xxhash.xxh3_128_digest(view[a : a + length]) for a in at.tolist()])
                c, e = np.frombuffer(names, "<i8").reshape(-1, 2).T
                which = np.repeat(np.arange(part.num_rows), sizes)
                doc_id, tkey, start = (part.column(x).to_numpy()[which] for x in ("doc_id", "tkey", "start"))
                cols = [c, e, doc_id, tkey, start + at - offsets[:-1][which]]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["c", "e", "doc_id", "tkey", "start"])

    windows = cut(strings.mapInArrow(named, "c long, e long, doc_id long, tkey long, start long"), "windows")
    firsts = cut(windows.groupBy("c", "e").agg(F.min(F.struct("doc_id", "start")).alias("f")), "first_windows")
    again = windows.join(firsts, ["c", "e"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("start") != F.col("f.start")))
    return again.select("doc_id", "tkey", "start", (F.col("start") + length).alias("end"))


def _found(docs: DataFrame, length: int) -> tuple[DataFrame, Placed, DataFrame]:
    """(light, the texts, the merged spans of documents with repeats)."""
    base = texts_of(docs).withColumn("tkey", F.xxhash64("text"))
    light = cut(base.select("doc_id", "tkey", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "light")
    # each text of a document once, where all later joins find it
    texts = Placed(base.dropDuplicates(["doc_id", "tkey"]) if light.count() > light.select("doc_id", "tkey").distinct().count() else base, "texts", "doc_id", "tkey")
    # what is joined with is written first: a join that has nothing but its inputs in
    # its stage can be split where one key has very many rows
    first = cut(light.groupBy("sha256").agg(F.min("doc_id").alias("first_id")), "first")
    light = cut(light.join(first, "sha256").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))), "light")
    keys = ["doc_id", "tkey"]
    # the smaller side, which has a key once, is looked up: the larger isn't sorted
    found_in = lambda df: df.hint("shuffle_hash")
    originals = light.where("not is_copy").select(*keys).distinct()
    anchors = cut(anchor_hashes(texts.df.join(found_in(originals), keys), length), "anchors")
    repeated = cut(anchors.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1"), "repeated")
    hits = anchors.join(found_in(repeated), "hash").select("tkey", "hash", "n").repartition("tkey")
    hits = hits.groupBy("tkey").agg(F.collect_list("hash").alias("hashes"), F.collect_list("n").alias("counts"))  # at most the anchors of one text
    hits = cut(hits, "hits").join(originals, "tkey")
    strings = cut(_strings(texts.df.join(found_in(hits), keys), length), "strings")
    name = ["c", "e"]
    firsts = cut(strings.groupBy(*name).agg(F.min("doc_id").alias("first_id")), "firsts")
    marked = strings.join(found_in(firsts), name)
    # several texts of one doc_id may each have such a string: they are compared
    here = (F.col("doc_id") == F.col("first_id")) & F.col("lead")
    marked = cut(marked.select("key", *keys, "start", "windows", here.alias("here")), "marked")
    later = marked.where("not here").select(*keys, "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    distinct = marked.where("here")
    several = cut(distinct.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.col("windows") + length - 1).alias("symbols")).where("k > 1").select("key", (F.col("symbols") > GROUP).alias("large")), "several")
    compared = cut(distinct.join(found_in(several), "key").select("key", *keys, "start", "windows", "large"), "compared")
    of = lambda large: found_in(compared.where("large" if large else "not large").groupBy(*keys).agg(F.collect_list(F.struct("key", "start", "windows")).alias("strings")))  # noqa: E731  at most the anchors of one text
    spans = later.union(_sorted_groups(_contents(texts.df.join(of(False), keys), length), length))
    if not several.where("large").isEmpty():
        spans = spans.union(_named_windows(_contents(texts.df.join(of(True), keys), length), length))
    merged = spans.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # at most the anchors of one text
    return light, texts, cut(merged, "spans")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(light, changed): *light* has doc_id, tkey, n_bytes, sha256 and is_copy of
    every row; *changed* has doc_id, tkey, text and spans (merged, of bytes) of
    the documents with repeats that are not exact copies of earlier ones."""
    light, texts, spans = _found(docs, length)
    return light, texts.df.join(spans.hint("shuffle_hash"), ["doc_id", "tkey"])


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(light, removed), both written: as repeated_spans and remove_spans give them;
    the table of texts that they came from is gone."""
    light, texts, spans = _found(docs, length)
    removed = cut(remove_spans(texts.df.join(spans.hint("shuffle_hash"), ["doc_id", "tkey"]), with_text), "removed")
    texts.drop()
    return light, removed


def remove_spans(changed: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, tkey, n_removed, n_spans, kept_sha256 and, with *with_text*, the kept
    bytes as text (kept_text; bytes of characters cut in two are dropped there)."""
    schema = "doc_id long, tkey long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tkey, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tkey", "text", "spans"))):
                data, kept, at, removed, runs = text.encode(), [], 0, 0, 0
                end = -1
                for s in spans:
                    a, b = s["start"], s["end"]
                    if a > end:
                        runs += 1
                        kept.append(data[at:a])
                    if b > end:
                        removed += b - max(a, end)
                        end = at = b
                kept.append(data[at:])
                kept = b"".join(kept)
                rows.append((doc, tkey, removed, runs, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else [])]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])

    return changed.mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and (with
    *with_text*) kept_text where something but not all was removed (else null).

    Null and empty texts have no bytes. Texts are UTF-8 bytes, so a removed run
    may cut a character. Rows that repeat a doc_id are judged by their place in
    it: equal rows don't make each other repeats. Rows without a doc_id stay whole
    and make nothing a repeat. An empty table gives an empty one; other columns
    are ignored."""
    light, removed = without_repeats(docs, length, with_text)
    out = light.join(removed, ["doc_id", "tkey"], "left")
    whole = F.col("is_copy") & (F.col("n_bytes") >= length)
    made = [
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    return out.select(*made, *([F.when(~whole, F.col("kept_text")).alias("kept_text")] if with_text else []))
