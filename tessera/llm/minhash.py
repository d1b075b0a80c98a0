"""Near-duplicate documents by an inverted join of MinHash coordinates.

Texts with the same shingle set form a class at once.  Each class is posted
under its coordinate-value pairs.  A pair of classes must collide in at least
MATCHES of COORDINATES coordinates; so, with each class's pairs in ascending
order of list length, two such classes meet in the lists of their shortest
COORDINATES - MATCHES + 1 pairs (the prefix).  Collisions are counted by merging
posting lists: a class merges the short lists of its prefix, and the long ones are
skipped, that is, only looked up for the classes that have been met.  What is
retained is confirmed on the full shingle sets.

No list is turned into all its pairs.

* First each class joins its hub, the class of its lists that collides most often
  overall; a hub's members, in blocks of bounded size that each have the hub, merge
  their lists in memory.  A family of near copies is linked to its hub by this, at a
  cost in proportion to it.
* Then the lists whose members are all linked are resolved.  Only members of the
  others meet once more, list by list, in blocks; a pair counts in the first list of
  both prefixes alone.  Signatures go first, and only classes that have a partner by
  them send their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, dealt, mix64, ragged, steps, texts_of
from tessera.llm.components import components
from tessera.llm.words import windows, words_of

WORDS = 5
SIMILARITY = 75  # per cent
COORDINATES = 48
#: A pair at the similarity limit falls short of so many collisions once in a million.
MATCHES = 20
#: Times that a family joins its hub's own hub: fewer families.
HUB_STEPS = 2
#: Classes whose lists are merged at once.
FEW = 32
#: Bytes of shingle sets, or of signatures, in one block.
BLOCK_BYTES = 8_000_000

_FACTORS = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets of each text)."""
    w = words_of(texts, lower=True)
    hashes, n = w.hashes(), np.diff(w.doc_start)
    found, at = windows(hashes, w.doc_start, size)
    bounds = np.searchsorted(at, w.doc_start)
    short = {}
    for few in range(1, size):
        rows = np.flatnonzero(n == few)
        if len(rows):
            h, first = windows(hashes, w.doc_start, few)
            short.update(zip(rows.tolist(), h[np.searchsorted(first, w.doc_start[rows])]))
    sets = [np.array([short[i]], np.uint64) if i in short else np.unique(found[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """A key for each coordinate-value pair of a non-empty set."""
    factors = _FACTORS[:coordinates, None]
    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024] * factors).min(1), out=low)
    return mix64(low + factors[:, 0])


def set_id(shingles: np.ndarray) -> bytes | None:
    """A name of 128 bits for a set of shingles; none for the empty set."""
    if not len(shingles):
        return None
    return mix64(shingles).sum().tobytes() + np.bitwise_xor.reduce(mix64(~shingles)).tobytes()


def signatures(base: DataFrame, size: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, cid (the set's name) and the coordinate keys; an empty
    set has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets, ends = shingle_sets(part.column("text"), size)
                own = [sets[a:b] for a, b in zip(ends[:-1], ends[1:])]
                keys = [signature(x, coordinates).tobytes() if len(x) else None for x in own]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), pa.array([set_id(x) for x in own], pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "cid", "keys"])

    return base.mapInArrow(run, "doc_id long, n_shingles long, cid binary, keys binary")


def postings(classes: DataFrame) -> DataFrame:
    """(key, cid) of every class and coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, np.int64) for x in batch.column("keys").to_pylist()]
            if keys:
                cid = batch.column("cid").take(pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), cid], ["key", "cid"])

    return classes.select("cid", "keys").mapInArrow(run, "key long, cid binary")


def prefixes(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(cid, weight, prefix) of every class that can have a partner: the keys of its
    prefix in order, and the length of all its lists. Pairs that one class alone
    has come first in the order, so a class with fewer than *matches* shared pairs
    has no prefix left."""
    posted = postings(classes)
    # written, so that the parts of a key that very many classes have can be split
    lists = cut(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    shared = posted.join(lists, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("pairs"), F.sum("n").alias("weight"))  # at most one for each coordinate
    prefix = F.transform(F.slice("pairs", 1, F.size("pairs") - matches + 1), lambda p: p["key"])
    return shared.where(F.size("pairs") >= matches).select("cid", "weight", prefix.alias("prefix"))


def listed(prefix: DataFrame) -> DataFrame:
    """(key, cid, weight), a row for each class and key of its prefix."""
    return prefix.select(F.explode("prefix").alias("key"), "cid", "weight")


def families(lists: DataFrame) -> DataFrame:
    """(cid, hub) of all classes that share a list of a prefix."""
    best = cut(lists.groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("h"), F.count("*").alias("n")).where("n > 1"), "best")
    hubs = cut(lists.select("key", "cid").join(best, "key").groupBy("cid").agg(F.max("h").alias("h")).select("cid", F.col("h.cid").alias("hub")), "hubs")
    for _ in range(HUB_STEPS):
        up = hubs.select(F.col("cid").alias("hub"), F.col("hub").alias("up"))
        hubs = cut(hubs.join(up, "hub", "left").select("cid", F.coalesce("up", "hub").alias("hub")), "hubs")
    return hubs


def sets_of(base: DataFrame, classes: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(cid, keys, shingles, size) of the classes (cid, doc_id), a row for each; the
    doc_id is that of a row with the class's text, among others perhaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets, ends = shingle_sets(part.column("text"), size)
                own = [x for x in (sets[a:b] for a, b in zip(ends[:-1], ends[1:])) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(x) for x in own], pa.binary()), pa.array([signature(x, coordinates).tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.nbytes for x in own], pa.int64())],
                    ["cid", "keys", "shingles", "size"],
                )

    found = base.join(classes.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "cid binary, keys binary, shingles binary, size long")
    return found.join(classes.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def _block(blocks, *key):
    return F.pmod(F.xxhash64(*key), blocks).cast("int")


def hub_classes(hubs: DataFrame, sets: DataFrame, matches: int = MATCHES, similarity: int = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(cid, component) of the members that are linked to others of their block,
    which the hub belongs to besides: the component is the hub where it is among
    them, so that it is one for all blocks of a family."""
    member = hubs.join(sets.select("cid", "size"), "cid")
    blocks = cut(member.groupBy("hub").agg((1 + F.floor(F.sum("size") / block_bytes)).cast("int").alias("blocks")), "blocks")
    others = member.where("cid != hub").join(blocks, "hub").select("hub", _block(F.col("blocks"), "cid").alias("block"), F.lit(1).alias("turn"), "cid")
    first = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("turn"), F.col("hub").alias("cid"))
    rows = first.union(others).join(sets, "cid").select("hub", "block", "turn", "cid", "keys", "shingles")
    rows = dealt(rows, "hub", "block").sortWithinPartitions("hub", "block", "turn", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, ("hub", "block"), ("cid", "keys", "shingles")):
            cid, keys, shingles = zip(*held)
            _, label = links_of(_matrix(keys), _sets(shingles), np.arange(len(cid)), matches, similarity)
            # rows are the hub, then the others in order: the first of a label names it
            names, at = np.unique(label, return_index=True)
            name = at[np.searchsorted(names, label)]
            moved = np.flatnonzero(name != np.arange(len(cid)))
            yield pa.RecordBatch.from_arrays([pa.array([cid[x] for x in moved], pa.binary()), pa.array([cid[x] for x in name[moved]], pa.binary())], ["cid", "component"])

    return rows.mapInArrow(run, "cid binary, component binary")


def unsettled(lists: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, cid, component) of the classes of every list whose classes aren't all
    linked."""
    placed = lists.select("key", "cid").join(linked, "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("component"))
    name = F.xxhash64("component")
    keys = cut(placed.groupBy("key").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a != b").select("key"), "unsettled")
    return placed.join(keys, "key", "left_semi")


def in_blocks(members: DataFrame, bytes_each, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, i, j, block, cid, component): each class of a list in every comparison,
    of block i with block j, that its own block takes part in. Nearly all lists are
    one block."""
    blocks = cut(members.groupBy("key").agg((1 + F.floor(F.sum(bytes_each) / block_bytes)).cast("int").alias("blocks")), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = members.join(blocks, "key").withColumn("block", _block(F.col("blocks"), "cid", "key")).select("key", "block", "cid", "component", other)
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "component")


def partnered(rows: DataFrame, prefix: DataFrame, keys: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(key, cid, component) of the classes that collide often enough with one of
    another component in their list, if it is the first that both prefixes have."""
    task = ["key", "i", "j"]
    rows = dealt(rows.join(prefix.select("cid", "prefix"), "cid").join(keys, "cid"), *task).sortWithinPartitions(*task, "block", "cid")
    schema = "key long, cid binary, component binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), held in _grouped(batches, task, ("block", "cid", "component", "prefix", "keys")):
            block, cid, component, prefix, keys = zip(*held)
            label, side = _labels(component), np.array(block) == j if i != j else None
            at = np.zeros(len(cid), bool)
            for x, y in colliding(_matrix(keys), label, matches, side):
                y = y[[_first_common(prefix[x], prefix[k]) == key for k in y]]
                at[y] = True
                at[x] |= len(y) > 0
            k = np.flatnonzero(at)
            cols = [pa.array([key] * len(k), pa.int64()), pa.array([cid[x] for x in k], pa.binary()), pa.array([component[x] for x in k], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "cid", "component"])

    return rows.mapInArrow(run, schema).distinct()


def list_links(rows: DataFrame, sets: DataFrame, matches: int = MATCHES, similarity: int = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect components, confirmed on full sets."""
    task = ["key", "i", "j"]
    rows = dealt(rows.join(sets, "cid"), *task).sortWithinPartitions(*task, "block", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in _grouped(batches, task, ("block", "cid", "component", "keys", "shingles")):
            block, cid, component, keys, shingles = zip(*held)
            label, side = _labels(component), np.array(block) == j if i != j else None
            links, _ = links_of(_matrix(keys), _sets(shingles), label, matches, similarity, side)
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([cid[x] for x in u], pa.binary()), pa.array([cid[x] for x in v], pa.binary())], ["u", "v"])

    return rows.mapInArrow(run, "u binary, v binary")


# --- one task ----------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch], by, columns) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with one key."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*by, *columns))):
            if row[: len(by)] != key:
                if held:
                    yield key, held
                key, held = row[: len(by)], []
            held.append(row[len(by) :])
    if held:
        yield key, held


def _matrix(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(len(keys), -1)


def _sets(shingles) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in shingles]


def _labels(component) -> np.ndarray:
    numbers: dict = {}
    return np.array([numbers.setdefault(x, len(numbers)) for x in component])


def _first_common(a: list[int], b: list[int]) -> int | None:
    have = set(b)
    return next((x for x in a if x in have), None)


def colliding(keys: np.ndarray, label: np.ndarray, matches: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows of another label that collide with it in *matches*
    coordinates or more), by merging posting lists; with *side*, only rows of one
    side with those of the other. *label* may change while this is read."""
    n, width = keys.shape
    if n <= FEW:  # so few lists are merged by counting all their rows at once
        times = (keys[:, None] == keys[None]).sum(2)
        times[np.tril_indices(n)] = 0
        for i in np.flatnonzero((times >= matches).any(1)) if side is None else np.flatnonzero(~side):
            row = times[i] if side is None else np.maximum(times[i], times[:, i])
            rows = np.flatnonzero((row >= matches) & (label != label[i]) & (True if side is None else side))
            if len(rows):
                yield int(i), rows
        return
    _, code = np.unique(keys, return_inverse=True)
    code = code.reshape(n, width)
    sizes = np.bincount(code.ravel())
    begin = np.cumsum(sizes) - sizes
    posted = np.argsort(code.ravel(), kind="stable") // width  # the lists one after another, rows ascending
    for i in range(n):
        if side is not None and side[i]:
            continue
        shared = np.flatnonzero(sizes[code[i]] > 1)
        if len(shared) < matches:
            continue
        shared = shared[np.argsort(sizes[code[i, shared]], kind="stable")]
        short, long = shared[: len(shared) - matches + 1], shared[len(shared) - matches + 1 :]
        met = posted[ragged(begin[code[i, short]], sizes[code[i, short]])]
        met = met[(label[met] != label[i]) & (met > i if side is None else side[met])]
        if not len(met):
            continue
        rows, times = np.unique(met, return_counts=True)
        times = times + (code[rows][:, long] == code[i, long]).sum(1)
        rows = rows[times >= matches]
        if len(rows):
            yield i, rows


def links_of(keys: np.ndarray, sets: list[np.ndarray], label: np.ndarray, matches: int, similarity: int, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(the links that merge the labels of one task, no more than one a merge; the
    labels merged)."""
    label = np.array(label)
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    names, local = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out, apart = np.zeros(len(names), bool), [], len(np.unique(label))
    for i, at in colliding(keys, label, matches, side):
        at = at[np.minimum(sizes[at], sizes[i]) * 100 >= similarity * np.maximum(sizes[at], sizes[i])]
        if not len(at):
            continue
        own = local[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[local[ragged(starts[at], sizes[at])]], np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
        mark[own] = False
        for j in at[100 * both >= similarity * (sizes[i] + sizes[at] - both)]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
                apart -= 1
        if apart == 1:
            break
    return out, label


# --- the operator ------------------------------------------------------------


def same_document(signed: DataFrame) -> DataFrame:
    """Links (u, v) of the classes that one doc_id has rows of."""
    known = signed.where("cid is not null and doc_id is not null")
    name = F.xxhash64("cid")
    several = cut(known.groupBy("doc_id").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a != b").select("doc_id"), "several")
    rows = known.join(several, "doc_id", "left_semi").select("doc_id", "cid").distinct()
    least = cut(rows.groupBy("doc_id").agg(F.min("cid").alias("v")), "least")
    return rows.join(least, "doc_id").where("cid != v").select(F.col("cid").alias("u"), "v")


def near_duplicates(docs: DataFrame, size: int = WORDS, similarity: int = SIMILARITY, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and empty texts and those without a word have an empty set, are linked
    with nothing and kept. A text of fewer words than a shingle has one shingle.
    Rows of one doc_id with different texts are one document: what is near any of
    them is linked with all. Rows without a doc_id are linked with nothing
    (component_id null) and kept. An empty table gives an empty one; other columns
    are ignored."""
    base = texts_of(docs)
    signed = cut(signatures(base, size, coordinates), "signatures")
    classes = cut(signed.where("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "classes")
    prefix = cut(prefixes(classes, matches), "prefixes")
    lists = listed(prefix)
    sets = cut(sets_of(base, prefix.select("cid").join(classes.select("cid", "doc_id"), "cid"), size, coordinates), "sets")
    linked = cut(hub_classes(families(lists), sets, matches, similarity), "linked")
    # signatures of the lists that are left, then the sets of what collides in them
    width = 8 * coordinates + 8 * (coordinates - matches + 1)
    left = cut(unsettled(lists, linked), "left")
    met = cut(partnered(in_blocks(left, F.lit(width)), prefix, classes.select("cid", "keys"), matches), "met")
    sized = cut(met.join(sets.select("cid", "size"), "cid"), "sized")
    late = list_links(in_blocks(sized, F.col("size")), sets, matches, similarity)
    edges = linked.select(F.col("cid").alias("u"), F.col("component").alias("v"))
    label = cut(components(edges.union(late).union(same_document(signed))), "components")
    inside = cut(classes.select("cid", "doc_id").join(label, F.col("cid") == F.col("id")).select("cid", "component", "doc_id"), "inside")
    least = cut(inside.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    of_class = classes.select("cid", "doc_id").join(inside.join(least, "component").select("cid", "least"), "cid", "left")
    of_class = cut(of_class.select("cid", F.coalesce("least", "doc_id").alias("least")), "of_class")
    out = signed.select("doc_id", "n_shingles", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
