"""Tokens by distinct segments against the libraries; files; packing; pieces."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import dac, packing, pieces, segments
from tests.llm.cases import empty_docs, odd_docs, odd_rows

TEXT = st.lists(st.sampled_from(list("ab cdE.,'\n\t 12é▁\x1c\x85İΣ😀中") + ["  ", "\n\n", "it's", "<|endoftext|>"]), max_size=40).map("".join)


@pytest.fixture(scope="module", params=[segments.BytePairs, segments.WordPairs, pieces.Pieces])
def encoder(request):
    return request.param()


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_ids_equal_the_library(encoder, texts):
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    assert len(ends) == len(texts) + 1
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == list(encoder.whole(t))


def test_small_cache_changes_nothing():
    texts = [r[1] or "" for r in odd_rows()]
    a = segments.BytePairs(cache_segments=3).encode(pa.array(texts))
    b = segments.BytePairs().encode(pa.array(texts))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_every_word_entry_encodes_to_itself():
    """What makes merging by rank exact for this vocabulary: an entry that no text
    can reach must not be made by the fast path either."""
    e = segments.WordPairs()
    import json

    model = json.load(open(segments.tokenizer_file("word_bpe_49k.json"), encoding="utf-8"))["model"]
    byte_of = {c: b for b, c in enumerate(segments._byte_alphabet())}
    for t, i in list(model["vocab"].items())[512:49406:7]:
        word = t.removesuffix("</w>")
        if t.endswith("</w>"):
            got = [e.ids[x] for x in e.fast(bytes(byte_of[c] for c in word) + b"\xff")]
            assert got == [i], t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70000), max_size=1200))
def test_codes_give_any_token_back(values):
    x = np.array(values, np.uint32)
    r = dac.Reader(dac.encode(x, [9], [0, len(x)]))
    assert (r.tokens() == x).all() and r.n_docs == 1
    assert [r.token(i) for i in range(len(x))] == values
    assert (r.document(0) == x).all()
    for a in range(0, len(x), 97):
        for b in (a, a + 1, a + 513, len(x)):
            assert r.slice(a, min(b, len(x))).tolist() == values[a : min(b, len(x))]
    with pytest.raises(IndexError):
        r.token(len(x))


def test_files_hold_documents_in_order(spark, tmp_path):
    docs = odd_docs(spark).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = dac.token_output(docs, str(tmp_path), shard_tokens=2000).orderBy("start").collect()
    lib = segments.WordPairs().library
    start = 0
    for r, (doc, text, *_) in zip(got, sorted(odd_rows(), key=lambda r: r[0])):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert len(list(tmp_path.glob("*.dac"))) > 1 and not list(tmp_path.glob("*.draft"))
    assert dac.token_output(empty_docs(spark), str(tmp_path / "e")).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_beside_a_null_keep_their_digits(spark, tmp_path):
    rows = [(None, "a"), (2**60 + 1, "b"), (2**60, "c"), (None, "a b"), (-5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = dac.token_output(docs, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -5, 2**60, 2**60 + 1] and [r["n_tokens"] for r in got] == [2, 3, 1, 2, 2]
    assert [r["start"] for r in got] == [0, 2, 5, 6, 8]


def test_columns_that_packing_makes_itself(spark):
    rows = [(1, 0, 5, 7, 8), (2, 0, 5, 9, 10)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, __rank int, __bucket int"), 10)
    assert sorted(tuple(r) for r in out.select("doc_id", "__rank", "__bucket").collect()) == [(1, 7, 8), (2, 9, 10)]


def test_pieces_outside_the_vocabulary(tmp_path):
    """A model without byte fallback: the byte pieces are unused there."""
    with open(segments.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    out = bytearray()
    for field, kind, value, start, end in pieces._fields(data):
        if field == 1 and any(f == 1 and v[:3] == b"<0x" for f, _, v, _, _ in pieces._fields(value)):
            own = b"".join(value[a:b] for f, _, _, a, b in pieces._fields(value) if f != 3) + b"\x18\x05"
            out += b"\x0a" + pieces._varint(len(own)) + own
        elif field == 2:
            own = b"".join(value[a:b] for f, _, _, a, b in pieces._fields(value) if f != 35) + b"\x98\x02\x00"
            out += b"\x12" + pieces._varint(len(own)) + own
        else:
            out += data[start:end]
    (tmp_path / "m.model").write_bytes(bytes(out))
    model = pieces.Pieces(str(tmp_path), "m.model")
    for text in ("a 𒀀𒀁 b", "𒀀", "plain"):
        ids, _ = model.encode(pa.array([text]))
        assert ids.tolist() == model.library.encode(text)
        spans = model.spans(text, ids)
        assert len(spans) == len(ids) and (spans[:, 0] <= spans[:, 1]).all() and spans[-1][1] == len(text.encode())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan(counts, 64)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter(counts)
    sequences, total = sum(n for _, n in plan), sum(k * n for k, n in counts.items())
    assert -(-total // 64) <= sequences <= 2 * total / 64 + 1


def test_plan_finds_exact_complements():
    assert sum(n for _, n in packing.plan({40: 3, 24: 3, 10: 2, 20: 2, 34: 2, 16: 8, 30: 2}, 64)) == 3 + 2 + 3


def test_packing(spark):
    got = packing.best_fit_pack(odd_docs(spark), 256).collect()
    lib = segments.BytePairs().library
    want = Counter()
    for doc, text, *_ in odd_rows():
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (s, n) in enumerate(packing.piece_bounds(len(ids), 256)):
            want[doc, k, s, n, zlib.crc32(ids[s : s + n])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.best_fit_pack(empty_docs(spark)).count() == 0


def test_only_the_first_piece_is_short():
    assert packing.piece_bounds(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]
    assert packing.piece_bounds(0, 4) == []


def test_pieces_of_documents(spark):
    model = pieces.Pieces()
    got = sorted(pieces.encode_documents(odd_docs(spark), with_spans=True).collect(), key=lambda r: r["doc_id"])
    for r, (doc, text, *_) in zip(got, sorted(odd_rows(), key=lambda r: r[0])):
        ids = [1, *model.library.encode(text or ""), 2]
        assert (r["doc_id"], r["n_tokens"]) == (doc, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
        data = (text or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r["piece_start"], r["piece_end"])) == data
    assert pieces.encode_documents(empty_docs(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_spans_cover_the_text(text):
    model = test_spans_cover_the_text.model
    ids, spans = model.encode_spans(text)
    data = text.encode()
    assert b"".join(data[a:b] for a, b in spans) == data
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


test_spans_cover_the_text.model = pieces.Pieces()


def compiled(entries: dict[bytes, bytes]) -> bytes:
    """A character map in the library's form; each node of the trie has 256 places
    of its own."""
    trie: dict = {}
    for key in entries:
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = key
    pool, at = b"", {}
    for key, new in entries.items():
        at[key] = len(pool)
        pool += new + b"\0"
    units, todo, blocks = {0: 0}, [(0, trie)], 0
    while todo:
        place, node = todo.pop()
        blocks += 1
        base = 256 * blocks
        units[place] |= (base ^ place) << 10 | (256 if None in node else 0)
        for byte, child in node.items():
            if byte is None:
                units[base] = at[child] | 1 << 31
            else:
                units[base + byte] = byte
                todo.append((base + byte, child))
    data = b"".join(units.get(k, 0).to_bytes(4, "little") for k in range(256 * (blocks + 1)))
    return len(data).to_bytes(4, "little") + data + pool


def test_character_map_takes_the_longest_prefix():
    m = pieces.CharacterMap(compiled({b"a": b"x", b"ab": b"yy", b"q": b""}))
    assert m.normalise("abacé") == ("yyxcé", pytest.approx(np.array([0, 0, 2, 3, 4, 5, 6])))
    assert m.normalise("q")[0] == ""
    assert pieces.CharacterMap().normalise("aé")[1].tolist() == [0, 1, 2, 3]


def test_texts_are_normalised_by_the_longest_prefix(tmp_path):
    """A model with a character map: ids as the library's, spans of original bytes."""
    with open(segments.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    entries = {"ﬁ": "fi", "é": "e", "ab": "yy", "abc": "x", "①": "1", "½": "1/2"}
    blob = compiled({k.encode(): v.encode() for k, v in entries.items()})
    out = bytearray()
    for field, kind, value, start, end in pieces._fields(data):
        if field == 3 and kind == 2:
            spec = b"".join(value[a:b] for f, _, _, a, b in pieces._fields(value) if f != 2) + b"\x12" + pieces._varint(len(blob)) + blob
            out += b"\x1a" + pieces._varint(len(spec)) + spec
        else:
            out += data[start:end]
    (tmp_path / "m.model").write_bytes(bytes(out))
    model = pieces.Pieces(str(tmp_path), "m.model")
    assert model.map.units is not None
    for text in ("ﬁne café abc ab abd", "① ½ x", "plain", "", "aab\nabcé", "  two  ﬁ"):
        ids, spans = model.encode_spans(text)
        assert ids.tolist() == model.library.encode(text)
        normal, align = model.map.normalise(text)
        assert len(align) == len(normal.encode()) + 1
        if len(ids):
            assert spans[0, 0] == 0 and spans[-1, 1] == len(text.encode()) and (spans[1:, 0] == spans[:-1, 1]).all()
    ids, spans = model.encode_spans("abcé")
    assert model.map.normalise("abcé")[0] == "xe" and {tuple(x) for x in spans.tolist()} <= {(0, 0), (0, 3), (3, 5), (0, 5)}


def test_longer_texts_than_a_step(spark, monkeypatch):
    """Slices of one text, of several and of a part of a batch give what whole
    batches give."""
    from tessera.llm import common, quality

    texts = [r[1] or "" for r in odd_rows()] + ["word " * 300_000]
    assert len(texts[-1]) > common.STEP_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(common.steps(batch, limit=1000))
    assert sum(p.num_rows for p in parts) == len(texts) and len(parts) > 3
    whole = quality.measure(pa.array(texts))
    for m in quality.MEASURES:
        assert np.concatenate([quality.measure(p.column("text"))[m] for p in parts]).tolist() == whole[m].tolist()


def test_entries_of_the_index_are_used_while_they_last():
    left = np.zeros(65, np.int64)
    left[[30, 20, 14, 10, 7, 3]] = [1, 2, 1, 1, 1, 1]
    index = packing.Complements(left)
    assert index.single(20, (44,)) == (20,) and index.single(21, (43,)) is None
    assert index.pair(40, (24,), 64) == (30, 10) and index.pair(40, (30,), 64) == (20, 20)
    assert index.triple(47, (17,)) == (30, 14, 3)
    left[30] = 0
    assert index.pair(40, (), 64) == (20, 20) and index.triple(47, ()) == (20, 20, 7)
    left[20] = 1
    assert index.pair(40, (), 64) is None
