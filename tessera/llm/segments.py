"""Exact, vectorised tokenisation by distinct white-space segments.

A text is cut at single spaces; no merge of the three public vocabularies
crosses such a cut, so each distinct segment is encoded once for a batch and
kept in a bounded cache.  Texts with any construct for which that is not
certain (runs of white space, unusual separators, special-token strings) go to
the library whole.  ``tests/llm/test_tokens.py`` compares with the libraries."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import ragged

#: Segments that a worker keeps; beyond it the cache starts anew.
CACHE_SEGMENTS = 300_000

_SPACE = re.compile(r"[\s\x1c-\x1f\x85]")
#: Characters whose classes and case are the same in every Unicode version in use.
_STABLE = re.compile("[\x00-ɏ]*").fullmatch


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies; the folder is a parameter."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Segments:
    """Base of the encoders: ``encode`` gives the ids of whole texts."""

    #: Ids that the marker before the first segment adds to each text.
    lead = 0
    marker = ""

    def __init__(self, cache_segments: int = CACHE_SEGMENTS):
        self.cache: dict[str, bytes | None] = {}
        self.cache_segments = cache_segments

    def segment(self, key: str) -> bytes | None:
        """Ids of one segment as little-endian unsigned 32-bit integers; None if
        it can't be encoded apart from its neighbours."""
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        """Ids of a whole text by the library."""
        raise NotImplementedError

    def _prepare(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring(texts, "\n", " \n")

    def _look_up(self, keys: list[str]) -> list[bytes | None]:
        cache = self.cache
        if len(cache) > self.cache_segments:
            cache.clear()
        out = list(map(cache.get, keys, [0] * len(keys)))
        for i, x in enumerate(out):
            if x == 0:
                out[i] = cache[keys[i]] = self.segment(keys[i])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); no nulls in texts."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        parts = pc.split_pattern(self._prepare(texts.cast(pa.large_string())), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        words = parts.flatten().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        blobs = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        odd = np.fromiter((x is None for x in blobs), bool, len(blobs))
        lengths = np.fromiter((0 if x is None else len(x) >> 2 for x in blobs), np.int64, len(blobs))
        pool = np.frombuffer(b"".join(x or b"" for x in blobs), "<u4")
        starts = np.cumsum(lengths) - lengths
        own = lengths[which]
        ids = pool[ragged(starts[which], own)]
        ends = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])]
        bad = np.zeros(n, bool)
        if odd.any():
            bad = np.zeros(n + 1, np.int64)
            np.add.at(bad, np.repeat(np.arange(n), counts), odd[which])
            bad = bad[:n] > 0
        if not bad.any() and not self.lead:
            return ids, ends
        pieces = [np.array(self.whole(texts[i].as_py()), np.uint32) if bad[i] else ids[ends[i] + self.lead : ends[i + 1]] for i in range(n)]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)


def _little(ids) -> bytes:
    return array("I", ids).tobytes()


class BytePairs(Segments):
    """The byte-level vocabulary (``byte_bpe_50k.json``)."""

    marker, lead = "\n", 1

    def __init__(self, folder: str | None = None, **more):
        super().__init__(**more)
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json", folder))
        with open(tokenizer_file("byte_bpe_50k.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.fast._core_bpe.encode_single_piece
        self.newline = self.whole("\n")

    def _prepare(self, texts):
        return pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), super()._prepare(texts), pa.scalar("", pa.large_string()))

    def segment(self, key):
        line = key[:1] == "\n"
        body = key[1:] if line else key
        if not body or _SPACE.search(body) or "<|" in body:
            return None
        text = body if line else " " + body
        if body.isalpha() and _STABLE(body):
            ids = self.piece(text.encode())
        else:
            ids = self.fast.encode_ordinary(text) if _STABLE(body) else self.whole(text)
        return _little(self.newline + ids if line else ids)

    def whole(self, text):
        return self.library.encode(text, add_special_tokens=False).ids


class WordPairs(Segments):
    """The lower-case vocabulary with word ends (``word_bpe_49k.json``).

    Merging by rank alone, as the fast path does, gives the file's merges where
    every entry encodes to itself; entries that don't are left out of the ranks,
    as no merge ever makes them."""

    def __init__(self, folder: str | None = None, **more):
        super().__init__(**more)
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_file("word_bpe_49k.json", folder)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(_byte_alphabet())}
        end = model["end_of_word_suffix"]
        raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(end)) + b"\xff" * t.endswith(end)
        vocab = model["vocab"]
        order = [bytes([b]) + b"\xff" for b in range(256)] + [bytes([b]) for b in range(256)]
        merged = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        order += [raw(a + b) for a, b in merged]
        known = {raw(t): i for t, i in vocab.items() if not t.startswith("<|")}
        self.ids = [known[x] for x in order]
        ranks = {x: i for i, x in enumerate(order)}
        ranks[b"\xff"] = len(ranks)
        self.fast = tiktoken.Encoding("word_pairs", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        # the split of the file's pre-tokeniser
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def _prepare(self, texts):
        return pc.replace_substring(texts, "\n", " ")

    def segment(self, key):
        if not key:
            return b""
        if "<|" in key:
            return None
        if not _STABLE(key) or _SPACE.search(key):
            return _little(self.whole(key))
        word, ids = key.lower(), self.ids
        out: list[int] = []
        for piece in (word,) if word.isalpha() else self.pieces(word):
            out += self.fast(piece.encode() + b"\xff")
        return array("I", [ids[i] for i in out]).tobytes()

    def whole(self, text):
        return self.library.encode(text, add_special_tokens=False).ids


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, by the usual rule: printable Latin-1
    characters stand for themselves, the others are numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]
