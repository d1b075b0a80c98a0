"""Suffix dedup, near-duplicates and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, minhash, suffixes, winnow
from tests.llm import cases


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 200])
@pytest.mark.parametrize("letters", [1, 2, 20])
@pytest.mark.parametrize("length", [3, 10, 100])
def test_suffix_order(n, letters, length):
    t = np.random.default_rng(n).integers(1, letters + 1, n)
    order = suffixes.suffix_names(t, length)
    prefixes = [tuple(t[i : i + length].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(n)) and prefixes == sorted(prefixes)


def test_equal_windows():
    rng = np.random.default_rng(0)
    strings = [rng.integers(97, 99, k).astype(np.uint8) for k in (3, 9, 30, 30, 50)]
    for length in (5, 9):
        group, which, start = suffixes.equal_windows(strings, length)
        found = {}
        for g, w, s in zip(group, which, start):
            found.setdefault(strings[w][s : s + length].tobytes(), set()).add(g)
        assert all(len(v) == 1 for v in found.values()) and len(found) == len(set(group))
        assert len(group) == sum(max(0, len(x) - length + 1) for x in strings)


@pytest.mark.parametrize("n", [2, 5, 60, 400])
@pytest.mark.parametrize("letters", [1, 2, 20])
def test_only_wanted_suffixes_are_ordered(n, letters):
    rng = np.random.default_rng(n)
    t = rng.integers(1, letters + 1, n)
    for share in (0.0, 0.1, 0.7):
        wanted = rng.random(n) < share
        order = suffixes.suffix_names(t, 20, wanted)
        prefixes = [tuple(t[i : i + 20].tolist()) for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and prefixes == sorted(prefixes)


def test_large_keys_keep_the_order():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 5, 300) + (1 << 30) - 5 for _ in range(3)]
    key, top = suffixes._key(*((c, 1 << 30) for c in columns))
    rank, n = suffixes._ranks(key, top)
    tuples = list(zip(*(c.tolist() for c in columns)))
    assert [sorted(set(tuples)).index(x) + 1 for x in tuples] == rank.tolist() and n == len(set(tuples))
    assert suffixes._order(key, 1 << 63).tolist() == suffixes._order(key, top).tolist() == np.argsort(key, kind="stable").tolist()


def test_copies_and_windows_that_nobody_asks_for_cost_no_sort(spark, monkeypatch):
    rows, keys, write = {}, [], suffixes.cut
    monkeypatch.setattr(suffixes, "cut", lambda df, what: rows.update({what: write(df, what)}) or rows[what])
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(3)]
    docs = [(i, texts[i % 3]) for i in range(30)] + [(40, texts[0][:300] + "#" + texts[0][301:])]
    assert removed(spark.createDataFrame(docs, "doc_id long, text string"), 100) == cases.without_repeats(docs, 100)
    assert rows["anchors"].select("tkey").distinct().count() == 4
    assert rows["anchors"].count() == rows["anchors"].distinct().count()  # a text's anchors once, however many copies it has
    # of strings of 104 bytes, five windows each are ordered: fewer keys than symbols
    order = suffixes._order
    monkeypatch.setattr(suffixes, "_order", lambda key, top: keys.append(len(key)) or order(key, top))
    data = np.frombuffer("".join(texts).encode()[:2080], np.uint8)
    group, at = suffixes.window_classes(data, np.arange(0, 2081, 104), 100)
    assert len(group) == 100 and keys[-1] <= 100


@pytest.mark.parametrize("hot", [False, True])
def test_texts_of_one_doc_id_are_judged_by_their_place(spark, monkeypatch, hot):
    if hot:
        for name, value in (("HOT", 3), ("PART", 4), ("GROUP", 300), ("BLOCK", 500)):
            monkeypatch.setattr(suffixes, name, value)
    passage = "".join(random.Random(4).choice("abcdefgh") for _ in range(60))
    docs = [(1, "x" * 5 + passage + "y"), (1, passage + "z" + passage), (2, "q" + passage), (2, "r" + passage + passage)]
    first = {}
    for doc, text in docs:
        for p in range(len(text) - 19):
            w = text[p : p + 20]
            first[w] = min(first.get(w, (doc, p)), (doc, p))
    want = set()
    for doc, text in docs:
        gone = {i for p in range(len(text) - 19) if first[text[p : p + 20]] != (doc, p) for i in range(p, p + 20)}
        want.add((doc, len(text), len(gone), hashlib.sha256("".join(x for i, x in enumerate(text) if i not in gone).encode()).hexdigest()))
    got = suffixes.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 20)
    assert {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()} == want


def removed(df, length):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.suffix_dedup(df, length).collect()}


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    if hot:
        for name, value in (("HOT", 3), ("PART", 4), ("GROUP", 300), ("BLOCK", 500)):
            monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 5, 30, 80])))) for i in range(40)] + [(50, None), (51, "a" * 300), (52, "xy" + "ab" * 100), (53, "é" * 50)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 10) == cases.without_repeats(rows, 10)


@pytest.mark.parametrize("group", [1, 2000, 1_000_000])
def test_hot_passages_in_other_contexts_equal_brute_force(spark, monkeypatch, group):
    for name, value in (("HOT", 3), ("GROUP", group)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [noise(n) for n in (100, 101, 120, 170, 400)]
    rows = []
    for i in range(60):
        p = passages[i % 5]
        at = rng.randrange(len(p))
        edited = p[:at] + noise(1) + p[at + 1 :] if i % 3 == 2 else p
        rows.append((i, noise(rng.randrange(200)) + edited + noise(rng.randrange(200))))
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 100) == cases.without_repeats(rows, 100)


def test_repeats_of_odd_tables(spark):
    rows = [(r[0], r[1]) for r in cases.odd_rows()]
    got = removed(cases.odd_docs(spark), 100)
    assert got == cases.without_repeats(rows, 100)
    assert got[12][1] > 100 and got[10][1] == len(rows[9][1])
    assert suffixes.suffix_dedup(cases.empty_docs(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base) if i % 3 else [f"v{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 5, 60]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(r[0] + 100, r[1]) for r in cases.odd_rows()[:-1]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == cases.components(rows)


def test_near_duplicates_of_odd_tables(spark):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(cases.odd_docs(spark)).collect()}
    assert not got[5]["kept"] and got[5]["component_id"] == 4 and got[10]["component_id"] == 8
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (1, 2, 3))
    assert minhash.near_duplicates(cases.empty_docs(spark)).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert [r["kept"] for r in minhash.near_duplicates(lone).collect()] == [True, True]


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """A family of near copies, and one whose members are just too far apart, in
    many blocks; lists are merged one by one and at once."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = [f"w{j}" for j in range(100)]
        for x in range(2 if i < 40 else 4):
            w[rng.randrange(100)] = f"e{i}.{x}"
        rows.append((i, " ".join(w)))
    want = {d: c for d, (_, c) in cases.components(rows).items()}
    assert len(set(want.values())) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = minhash.in_blocks
    for few in (0, 32):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "in_blocks", lambda m, b: blocks(m, b, 5000))
        monkeypatch.setattr(minhash.hub_classes, "__defaults__", (minhash.MATCHES, minhash.SIMILARITY, 5000))
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("n", [2, 5, 30])
def test_merged_lists_count_collisions(monkeypatch, n):
    rng = np.random.default_rng(n)
    keys = (rng.integers(0, 3, (n, 12)) + np.arange(12) * 10).astype(np.uint64)
    label = rng.integers(0, 4, n)
    for side in (None, rng.random(n) < 0.5):
        want = {(i, j) for i in range(n) for j in range(n) if label[i] != label[j] and (keys[i] == keys[j]).sum() >= 5 and (i < j if side is None else not side[i] and side[j])}
        for few in (0, 32):
            monkeypatch.setattr(minhash, "FEW", few)
            assert {(i, int(j)) for i, x in minhash.colliding(keys, label, 5, side) for j in x} == want


def rolled(text, gram, window):
    """(hash, place) kept: the smallest of each window, the rightmost of equals."""
    one = lambda x: int(winnow.fingerprint(winnow.code_points(x), len(x), 1)[0][0])
    hashes = [one(text[i : i + gram]) for i in range(len(text) - gram + 1)] if len(text) >= gram else [one(text)] if text else []
    w = min(window, len(hashes))
    kept = {max(range(i, i + w), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - w + 1)} if hashes else set()
    return [(hashes[j], j) for j in sorted(kept)]


@pytest.mark.parametrize("gram,window", [(5, 4), (1, 3), (3, 1), (20, 21)])
def test_fingerprints_equal_brute_force(gram, window):
    rng = random.Random(gram)
    for n in (0, 1, 2, 4, 5, 8, 9, 60, 300):
        text = "".join(rng.choice("abé") for _ in range(n))
        h, at = winnow.fingerprint(winnow.code_points(text), gram, window)
        assert list(zip(h.tolist(), at.tolist())) == rolled(text, gram, window)


def test_winnowing_keeps_rightmost_minima_and_its_promise():
    rng = np.random.default_rng(5)
    for n in (0, 1, 4, 5, 6, 40, 400):
        c = rng.integers(97, 99, n).astype(np.uint32)
        h, at = winnow.fingerprint(c, 5, 4)
        assert sorted(set(at.tolist())) == at.tolist() and len(h) == len(at)
    shared = rng.integers(97, 123, 60).astype(np.uint32)
    a, b = (np.concatenate([rng.integers(97, 123, k), shared, rng.integers(97, 123, 30)]).astype(np.uint32) for k in (17, 40))
    assert set(winnow.fingerprint(a)[0]) & set(winnow.fingerprint(b)[0])
    assert winnow.likeness(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1.0


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_edited_texts(spark, ranges):
    rows = [(r[0], r[1] or "") for r in cases.odd_rows()]
    rows.sort()
    got = winnow.edited_likeness(cases.odd_docs(spark).repartition(4), ranges=ranges).collect()
    assert len(got) == len(rows)
    edits = [t[: len(t) - len(t) // 4] + rows[(i + 1) % len(rows)][1][: len(t) // 4] for i, (_, t) in enumerate(rows)]
    place = {(d, hashlib.sha256(e.encode()).hexdigest()): i for i, ((d, _), e) in enumerate(zip(rows, edits))}  # equal rows in any order
    got = sorted(got, key=lambda r: place[r["doc_id"], r["edited_sha256"]])
    for i, (doc, text) in enumerate(rows):
        n = len(text) // 4
        edited = text[: len(text) - n] + rows[(i + 1) % len(rows)][1][:n]
        r = got[i]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        kept, new, after = ({h for h, _ in rolled(t, winnow.GRAM, winnow.WINDOW)} for t in (text[:3000], edited[:3000], rows[(i + 1) % len(rows)][1][:3000])) if len(text) < 3000 else (None, None, None)
        if kept is not None and len(rows[(i + 1) % len(rows)][1]) < 3000:
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            assert (r["near_edited"], r["near_next"]) == (like(kept, new), like(kept, after))
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (text == edited)
    assert got[7]["fingerprint"] == got[9]["fingerprint"]
    assert winnow.edited_likeness(cases.empty_docs(spark), ranges=ranges).count() == 0
    assert winnow.fingerprints(cases.odd_docs(spark)).count() == len(rows)


def test_a_lone_document_follows_itself(spark):
    r = winnow.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


def test_a_document_of_very_many_rows_is_dealt_over_ranges(spark):
    rows = [(None if i % 3 else 7, f"text {i} of a document") for i in range(90)] + [(9, "last")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = winnow.texts_of(docs).select("*", F.xxhash64("text").alias("h"), F.lit(1).alias("times")).distinct()
    parts = winnow.with_neighbours(base, 8).where("not extra").groupBy("bucket").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 45
    a, b = (sorted(map(tuple, winnow.edited_likeness(docs, ranges=n).collect()), key=str) for n in (1, 8))
    assert a == b and len(a) == 95
