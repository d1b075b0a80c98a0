"""SentencePiece encoding that keeps the place of every piece in the text.

The text is first normalised by the model's compiled character map: at each
byte the longest entry of the map that matches is replaced, else one character
is copied; for every normalised byte the original offset is recorded.  Spaces
become the escape mark, after the dummy prefix, and pieces are projected
through the alignment to spans of original bytes.

The normalised text is cut where no piece can span: no entry of the vocabulary
has the escape mark after another character, nor a line feed.  Each distinct cut
is encoded once by the library.  If a model's vocabulary has such an entry, or a
text has runs of spaces, the library encodes the whole text."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import TOKEN_STEP, steps, texts_of
from tessera.llm.segments import CACHE_SEGMENTS, Segments, _little, tokenizer_file

MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int, int, int]]:
    """(field, wire kind, value, start, end) of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        start = at
        key = varint()
        kind = key & 7
        if kind == 0:
            value: bytes | int = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value = data[at : at + n]
            at += n
        else:
            raise ValueError("not a model file")
        yield key >> 3, kind, value, start, at


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 keys and a pool of
    zero-terminated replacements.  An empty map copies every character."""

    def __init__(self, blob: bytes = b""):
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.pool = blob[4 + size :]
        else:
            self.units, self.pool = None, b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at *at*."""
        if self.units is None:
            return None
        units, found = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != data[i]:  # the label; bit 31 marks leaves
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, original byte offset of each of its bytes and of its end)."""
        data = text.encode()
        if self.units is None:
            return text, np.arange(len(data) + 1)
        out, align, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                out += data[at : at + n]
                align += range(at, at + n)
            else:
                n, new = hit
                out += new
                align += [at] * len(new)
            at += n
        return out.decode(), np.array([*align, len(data)], np.int64)


class Pieces(Segments):
    """Encodes and decodes with a model file whose white space is escaped and
    kept (no removal of extra spaces)."""

    def __init__(self, folder: str | None = None, model: str = "piece_bpe_32k.model", cache_segments: int = CACHE_SEGMENTS):
        super().__init__(cache_segments)
        import sentencepiece

        with open(tokenizer_file(model, folder), "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        # the same model without its character map, which is applied here, and that
        # without the dummy prefix too, for text after a line feed
        self.map = CharacterMap()
        mapless, bare = bytearray(), bytearray()
        for field, kind, value, start, end in _fields(data):
            if field == 3 and kind == 2:
                spec = b""
                for f, k, v, a, b in _fields(value):
                    if f == 2:
                        self.map = CharacterMap(v)
                    elif f == 3:
                        self.dummy_prefix = bool(v)
                    elif f == 4 and v:
                        raise ValueError("models that remove extra spaces aren't supported")
                    if f not in (2, 3):
                        spec += value[a:b]
                for model, prefix in ((mapless, self.dummy_prefix), (bare, False)):
                    own = spec + (b"\x18\x01" if prefix else b"\x18\x00")
                    model += b"\x1a" + _varint(len(own)) + own
            else:
                mapless += data[start:end]
                bare += data[start:end]
        self.mapless, self.bare = (sentencepiece.SentencePieceProcessor(model_proto=bytes(x)) for x in (mapless, bare))
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.cuts = self.dummy_prefix and not any(MARK in x.lstrip(MARK) or "\n" in x or " " in x for x in names)
        self.newline = self.bare.encode("\n")
        #: Bytes of normalised text that a piece covers, with the mark as the space it stands for, and as itself.
        self.width = np.array([0 if self.library.is_control(i) else 1 if _BYTE.match(x) else len(x.replace(MARK, " ").encode()) for i, x in enumerate(names)], np.int64)
        self.wide = np.array([0 if self.library.is_control(i) else 1 if _BYTE.match(x) else len(x.encode()) for i, x in enumerate(names)], np.int64)

    def segment(self, key):
        if not self.cuts:
            return None
        line = key[:1] == "\n"
        body = key[1:] if line else key
        if not (body or line) or MARK in body or "\x00" in body:
            return None
        if not line:
            return _little(self.mapless.encode(body))
        return _little(self.newline + self.bare.encode(body))

    def whole(self, text):
        return self.mapless.encode(text)

    def encode(self, texts):
        """As the library encodes each text: its longest-prefix normalisation is
        encoded by the model without a map. An empty text has no ids."""
        if self.map.units is not None:  # an empty map copies every character
            texts = pa.array([self.map.normalise(t)[0] for t in texts.to_pylist()], pa.large_string())
        ids, ends = super().encode(texts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if not empty.any():
            return ids, ends
        keep = [ids[ends[i] : ends[i + 1]] if not empty[i] else ids[:0] for i in range(len(texts))]
        return np.concatenate(keep), np.concatenate([[0], np.cumsum([len(x) for x in keep])]).astype(np.int64)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Original [start, end) bytes of each piece of a text; the mark of the
        dummy prefix covers none."""
        ids = np.asarray(ids)
        if not len(ids):
            return np.zeros((0, 2), np.int64)
        if (ids == self.library.unk_id()).any():  # such a piece has no width of its own: as the library aligns it
            told = self.library.encode(text, return_type="proto").pieces
            return np.array([(p.begin, p.end) for p in told], np.int64).reshape(-1, 2)
        if self.map.units is None and MARK not in text:  # a mark is a space: one byte for one byte
            ends = np.cumsum(self.width[ids]) - self.dummy_prefix
            return np.stack([np.concatenate([[0], ends[:-1]]), ends], 1)
        align = self.escaped_alignment(text)
        ends = np.cumsum(self.wide[ids])
        return np.stack([align[ends - self.wide[ids]], align[ends]], 1)

    def escaped_alignment(self, text: str) -> np.ndarray:
        """Original byte offset of each byte of the normalised and escaped text."""
        normal, align = self.map.normalise(text)
        data = np.frombuffer(normal.encode(), np.uint8)
        times = np.where(data == 32, len(MARK.encode()), 1)
        out = np.repeat(align[:-1], times)
        lead = np.zeros(len(MARK.encode()) * self.dummy_prefix, np.int64)
        return np.concatenate([lead, out, align[-1:]])

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = self.encode(pa.array([text]))
        return ids, self.spans(text, ids)


def encode_documents(docs: DataFrame, folder: str | None = None, begin: bool = True, end: bool = True, with_spans: bool = False) -> DataFrame:
    """Encodes every whole text (null: empty) and decodes the ids again.

    Gives doc_id, n_tokens, ids_sha256, decoded_sha256, spans_end (bytes of the
    text that the last piece ends at) and, with *with_spans*, ids, piece_start
    and piece_end. Repeated rows stay; an empty table gives an empty one."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_end long" + (", ids array<int>, piece_start array<long>, piece_end array<long>" if with_spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(folder)
        first = [model.library.bos_id()] if begin else []
        last = [model.library.eos_id()] if end else []
        for batch in batches:
            for part in steps(batch, limit=TOKEN_STEP):
                ids, ends = model.encode(part.column("text"))
                rows = []
                for i, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())):
                    own = ids[ends[i] : ends[i + 1]]
                    spans = model.spans(text, own)
                    full = np.concatenate([np.array(first, np.uint32), own, np.array(last, np.uint32)]).astype("<u4")
                    decoded = model.library.decode(full.tolist())
                    row = (doc, len(full), hashlib.sha256(full).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(spans[-1, 1]) if len(spans) else 0)
                    rows.append(row + ((own.astype(np.int32), spans[:, 0], spans[:, 1]) if with_spans else ()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())][: 5 + 3 * with_spans]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])

    return texts_of(docs).mapInArrow(run, schema)
