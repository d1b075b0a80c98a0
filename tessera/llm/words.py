"""Words of whole texts as numpy arrays: positions and content hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import bytes_of, content_hashes, mix64

#: Bytes that part words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = 0x9FB21C651E98DF25


@dataclass
class Words:
    """Words of the texts of a slice. *doc_start* has the first word of each text
    and one entry more; *data* holds the texts with a space after each, which
    *offsets* parts. A text without words, an empty one say, has none."""

    data: np.ndarray
    offsets: np.ndarray
    space: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc_start: np.ndarray

    def hashes(self) -> np.ndarray:
        return content_hashes(self.data, self.starts, self.ends)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of texts without nulls (callers make null texts empty); *lower* lowers
    A-Z only. No texts, or only empty ones, give no words."""
    texts = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, offsets = bytes_of(texts)
    if lower:
        data = _LOWER[data]
    space = SPACE[data]
    edge = np.empty(len(space), bool)
    if len(edge):
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)  # starts and ends alternate, as each text ends in a space
    starts, ends = at[::2], at[1::2]
    return Words(data, offsets, space, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, doc_start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of *size* words that lies in one text, its first word);
    a text of fewer words has none. Every step mixes all bits, so that words in
    another order or run give another hash."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = mix64(out * np.uint64(_MULTIPLIER) + hashes[j : n + j])
    inside = np.ones(n, bool)
    for j in range(1, size):  # a window from w to w+size-1 crosses a text's start at w+j
        cross = doc_start - j
        cross = cross[(cross >= 0) & (cross < n)]
        inside[cross] = False
    first = np.flatnonzero(inside)
    return mix64(out[first] + np.uint64(size)), first


def within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that tell equal content in different texts apart."""
    return mix64(hashes ^ mix64(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
