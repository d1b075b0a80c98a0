"""Packed texts: base64 of zlib of one pickled string, read without unpickling.

The pickle is read opcode by opcode.  Only those that say its version, hold one text
and end it are let through; anything else, so whatever could import, call or build
an object, makes the packed text hostile, and nothing of it is used."""

from __future__ import annotations

import base64
import binascii
import json
import pickletools
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a packed text may unfold to.
UNFOLDED = 256 << 20

_TEXT = {"SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "UNICODE"}
_PLAIN = {"PROTO", "FRAME", "MEMOIZE", "BINPUT", "LONG_BINPUT", "PUT", "STOP"}


def pickled_text(data: bytes) -> str | None:
    """The text that a pickle holds, if it holds one text and nothing else."""
    found = None
    try:
        for op, value, _ in pickletools.genops(data):
            if op.name in _TEXT and found is None:
                found = value
            elif op.name not in _PLAIN:
                return None
    except (ValueError, UnicodeDecodeError, IndexError):
        return None
    return found


def unfolded(text: str, limit: int = UNFOLDED) -> str | None:
    """The string of a packed text; null if it is anything else or too large."""
    try:
        raw = base64.b64decode(text, validate=True)
        stream = zlib.decompressobj()
        data = stream.decompress(raw, limit)
        if stream.unconsumed_tail or not stream.eof:
            return None
    except (binascii.Error, zlib.error, ValueError):
        return None
    return pickled_text(data)


def unpacked_json(x, limit: int = UNFOLDED) -> Column:
    """struct(value, kind): JSON text as it is (plain), what a packed text holds, if
    that is JSON (packed), else null: refused. Null and blank texts are empty, null."""

    @F.pandas_udf("struct<value:string,kind:string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            if text is None or not text.strip():
                return None, "empty"
            for kind, found in (("plain", text), ("packed", None)):
                found = unfolded(text, limit) if kind == "packed" else found
                try:
                    if found is not None:
                        json.loads(found)
                        return found, kind
                except (ValueError, RecursionError):
                    pass
            return None, "refused"

        return pd.DataFrame([one(t) for t in texts], columns=["value", "kind"], index=texts.index)

    return read(F.col(x) if isinstance(x, str) else x)
