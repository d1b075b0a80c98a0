"""Ranked search, runs of repeated words and repeated lines, by brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, queries, runs, wand
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACES = " \t\n\x0b\x0c\r"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def best(docs, items, top=10):
    """{item: [(rank, doc, score)]} by scoring every document."""
    terms = [(d, TERM.findall(lowered(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    counts = [Counter(w) for _, w in terms]
    df = Counter(t for c in counts for t in c)
    query = defaultdict(list)
    for item, text in items:
        query[item] += TERM.findall(lowered(text))
    out = {}
    for item, q in query.items():
        found = []
        for (doc, w), c in zip(terms, counts):
            m = 25 + 75 * len(w) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out[item] = [(k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return {k: v for k, v in out.items() if v}


def by_item(df):
    out = defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return out


def test_search_equals_scoring_every_document(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["ünd", "中文", "THE", "the"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "!!! ---"), (None, "w3 w4"), (None, docs[3][1]), (2**60 + 1, docs[5][1]), (2**60, docs[5][1]), (7, docs[7][1])]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)] + [(40, None), (41, ""), (42, "nowhere"), (43, "w3 W3 w3"), (43, "w4")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, item_id string").repartition(3)
    q = spark.createDataFrame([(*r, 9, 9) for r in items], "item_id long, text string, score int, doc_id int")
    want = best(docs, items)
    assert by_item(wand.ranked(d, q)) == want
    # small shards, items in several blocks
    assert by_item(wand.ranked(d, q, shard_bytes=500, block_terms=60)) == want
    assert by_item(wand.ranked(d, q, top=3)) == best(docs, items, 3)
    assert wand.ranked(d.where("false"), q).count() == 0 and wand.ranked(d, q.where("false")).count() == 0


def test_search_of_odd_documents_in_steps(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in cases.odd_rows()]
    items = [(1, cases.PASSAGE), (2, "one two three"), (3, "w7 x3 ä")]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = by_item(wand.ranked(cases.odd_docs(spark), q, shard_bytes=1000))
    want = best(rows, items)
    assert {k: [x[2] for x in v] for k, v in got.items()} == {k: [x[2] for x in v] for k, v in want.items()}
    assert {k: sorted(x[1] for x in v) for k, v in got.items()} == {k: sorted(x[1] for x in v) for k, v in want.items()}


def test_documents_below_the_threshold_are_not_scored():
    vocabulary = np.sort(wand.terms_of(pa.array(["rare common usual"]))[0])
    texts = ["rare common usual"] * 10 + ["common filler " * 5] * 3000
    names, first = wand.terms_of(pa.array(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    number = np.searchsorted(vocabulary, names)
    ours = (number < 3) & (vocabulary[np.minimum(number, 2)] == names)
    pairs, counts = np.unique(number[ours] * len(texts) + doc[ours], return_counts=True)
    terms, dfs = np.unique(pairs // len(texts), return_counts=True)
    ids = np.arange(len(texts))
    row = {"docs": ids.tobytes(), "known": np.ones(len(texts), bool).tobytes(), "sizes": np.diff(first).tobytes(), "posted": (pairs % len(texts)).astype(np.int32).tobytes(), "counts": counts.astype(np.int64).tobytes(), "terms": terms.tolist(), "dfs": dfs.tolist()}
    shard, heap = wand.Shard(row, len(texts), int(first[-1])), []
    assert shard.search([(int(t), wand.weight(len(texts), int(n))) for t, n in zip(terms, dfs)], heap, 10) < 20
    assert sorted(-x[2] for x in heap) == list(range(10))


def brute_runs(words):
    out = []
    for p in range(1, len(words) // 3 + 1):
        same = [words[i] == words[i + p] for i in range(len(words) - p)] + [False]
        start = 0
        for i, s in enumerate(same):
            if not s:
                length = i - start + p
                stretch = words[start : start + length]
                if length >= max(24, 3 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                    out.append((start, length, p))
                start = i + 1
    return sorted(out)


def digests(doc, text):
    words = cases.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(found), top, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def run_texts():
    rng = random.Random(8)
    out = []
    for k in range(250):
        words = []
        for _ in range(rng.randint(0, 5)):
            period = [f"w{rng.randint(0, rng.choice([1, 2, 400]))}" for _ in range(rng.randint(1, 30))]
            words += (period * 7)[: rng.randint(1, 6 * len(period))]
            words += [f"x{rng.randint(0, 300)}" for _ in range(rng.randint(0, 30))]
        out.append(" ".join(words[:400]).replace("w1 ", "w1\n\t"))
    return out


def test_runs_equal_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(run_texts())] + [(r[0] + 1000, r[1]) for r in cases.odd_rows() if len(r[1] or "") < 10000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10
    for doc, text in rows:
        n, top, listed, rest = digests(doc, text)
        r = got[doc]
        assert (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) == (n, listed, rest), doc
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)


def test_runs_of_odd_documents(spark):
    out = {r["doc_id"]: r for r in runs.periodic_runs(cases.odd_docs(spark)).collect()}
    assert out[1]["runs"] == [] and out[1]["strongest"] is None and out[1]["text"] == "" and out[1]["n_words"] == 0
    assert out[14]["runs"][0].asDict() == {"start": 0, "length": 150, "period": 5} and out[14]["text"] == "a b c d e"
    assert out[6]["n_words"] == 24000 and out[12]["text"].endswith("中文 😀")
    assert runs.periodic_runs(cases.odd_docs(spark)).count() == len(cases.odd_rows())
    assert runs.periodic_runs(cases.empty_docs(spark)).count() == 0
    unnamed = spark.createDataFrame([(None, "a " * 30)], "doc_id long, text string")
    assert runs.periodic_runs(unnamed).first()["strongest"]["length"] == 30


def test_long_runs_at_every_scale():
    for codes, whole in (([0] * 30_000, (0, 30_000, 1)), (([0] * 3000 + [1]) * 7, (0, 21_007, 3001)), (list(range(5000)) * 3 + [7], (0, 15_000, 5000))):
        seen, last = {}, []
        for i, c in enumerate(codes):
            last.append(i - seen[c] if c in seen else runs.FAR)
            seen[c] = i
        assert whole in runs.runs_of(np.array(codes), np.array(last))


def test_strongest_run_is_exact():
    assert runs.strongest([(0, 24, 7), (5, 10**17 + 1, 10**16), (9, 10**17, 10**16 - 1)]) == (9, 10**17, 10**16 - 1)
    assert runs.strongest([(0, 30, 10), (2, 60, 20), (3, 30, 10)]) == (0, 30, 10) and runs.strongest([]) is None


def without_lines(rows, min_docs=10, min_chars=1, keep_first=False):
    key = lambda line: lowered(line.strip(SPACES))
    where = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc)
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        keep = []
        for line in (text or "").split("\n"):
            k = key(line)
            gone = len(k) >= min_chars and len(where[k]) >= min_docs
            if not gone or keep_first and k not in seen:
                keep.append(line)
            if gone:
                seen.add(k)
        out.append((doc, len((text or "").split("\n")), len((text or "").split("\n")) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    pool = [f"Line {i}" for i in range(60)] + ["", " ", "ÄÖ", "x"]
    rows = []
    for d in range(300):
        own = [rng.choice(["  ", "", "\t"]) + (x if rng.random() < 0.8 else x.upper()) + rng.choice(["", " \r"]) for x in rng.choices(pool, weights=[100 / (k + 1) for k in range(len(pool))], k=rng.randint(0, 9))]
        rows.append((d, "\n".join(["Licence" if d % 3 else f"only {d}", *own, "licence  "])))
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (None, "Line 1\nmine")]


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_equal_brute_force(spark, keep_first):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 3, True) for r in rows], "doc_id long, text string, n_lines int, keep boolean").repartition(5)
    for min_docs, min_chars in ((10, 1), (2, 3), (1, 1)):
        got = lines.line_dedup(docs, min_docs, min_chars, keep_first).collect()
        assert sorted([tuple(r) for r in got], key=str) == without_lines(rows, min_docs, min_chars, keep_first)
    assert lines.line_dedup(docs.where("false")).count() == 0 and lines.keep_bitmaps(docs.where("false")).count() == 0


def test_rows_of_one_document_count_once(spark):
    text = "again\nmine"
    rows = [(1, text)] * 12 + [(1, "again\nother"), (2, "again")] + [(3 + i, "shared\nagain") for i in range(9)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in got} == {(1, "mine", 1), (1, "other", 1), (2, "", 1), *((3 + i, "shared", 1) for i in range(9))}


@pytest.mark.parametrize("seed", range(6))
def test_streams_of_ranges_join_up(spark, seed):
    """Names are cut by ranges and batches anywhere."""
    rng = random.Random(seed)
    rows = sorted({(rng.choice([1, 2, 2, 2, 3, 4]), rng.randint(0, 25), 0, rng.randint(0, 1)) for _ in range(60)})
    for keep_first in (False, True):
        settled = []
        cuts = sorted(rng.sample(range(len(rows) + 1), 3))
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            stream, part = lines.Stream(5, keep_first), rows[a:b]
            while part:
                k = rng.randint(1, 7)
                cols = list(zip(*part[:k]))
                batch = pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array([2] * len(cols[0])), pa.array(cols[3])], lines._OCCURRENCE)
                settled += stream.take(batch).to_pylist()
                part = part[k:]
            out = stream.end()
            settled += out.to_pylist() if out is not None else []
        names = defaultdict(list)
        for r in rows:
            names[r[0]].append(r)
        left = [r for r in settled if r["state"] != lines.DROPPED]
        gone = [(r["h1"], r["doc_id"], r["row"], r["at"]) for r in settled if r["state"] == lines.DROPPED]
        for name, own in names.items():
            mine = [r for r in left if r["h1"] == name]
            waiting = sorted((name, r["doc_id"], r["row"], r["at"]) for r in mine if r["state"] == lines.OPEN)
            if any(r["state"] == lines.ENOUGH for r in mine) or len({r[1] for r in waiting}) >= 5:
                gone += waiting[1:] if keep_first else waiting
        want = [r for own in names.values() if len({x[1] for x in own}) >= 5 for r in (own[1:] if keep_first else own)]
        assert sorted(gone) == sorted(want)


def test_bitmaps_are_compressed():
    keep = np.ones(100_000, bool)
    keep[5000:] = False
    assert len(lines.packed(keep)) < 100 and (lines.unpacked(lines.packed(keep), len(keep)) == keep).all()
    small = np.array([True, False, True])
    assert len(lines.packed(small)) == 2 and (lines.unpacked(lines.packed(small), 3) == small).all()


def test_a_line_in_a_third_of_all_documents_fills_several_ranges(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("own "), "id")), F.lit("\n"), F.concat(F.lit("line "), "id")).alias("text"))
    found = lines.occurrences(lines.keyed(docs))
    out = lines.repeated_lines(found)
    assert out.count() == 1000
    ranges = found.repartitionByRange(4, "h1", "h2", "doc_id", "row", "at").withColumn("p", F.spark_partition_id())
    hot = ranges.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    assert ranges.join(F.broadcast(hot), ["h1", "h2"]).select("p").distinct().count() > 1
