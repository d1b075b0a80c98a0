"""Small tables that hold every odd case, and brute-force versions of operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "this passage of quite a few words is found in several documents of the corpus and it is long enough to be seen as a repeat of itself by anyone who looks"


def odd_rows() -> list[tuple]:
    long_text = " ".join(f"w{i * 7919 % 1000} x{i % 17}" for i in range(12000))
    near = " ".join(f"token{i}" for i in range(60))
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (4, "one two three", "en", "a", 13),
        (5, "ONE two Three", "en", "b", 13),
        (6, long_text, "en", "a", len(long_text)),
        (7, long_text + " end", "en", "a", None),
        (8, near, "de", "b", 0),
        (9, near.replace("token30", "other"), "de", "b", 0),
        (10, near, "de", "b", 0),
        (11, "intro " + PASSAGE + " tail one", "fr", "b", 0),
        (12, PASSAGE + " ünd möre 中文 😀", "fr", "c", 0),
        (13, "ä" * 150, "fr", "c", 0),
        (14, "a b c d e " * 30, "es", "c", 0),
        (15, "mail me@home.org or +1 (235) 555-3833, 10.0.0.1, card 4111 1111 1111 1111", "es", "c", 0),
        (16, "<|endoftext|> a  b\r\n\x1cc", "es", "c", 0),
        (17, "12345 !!! ???", "xx", "c", 0),
        (17, "12345 !!! ???", "xx", "c", 0),
    ]


#: Extra columns with names that operators use themselves.
EXTRA = "kept boolean, spans string, length long, key long, component_id long, score double, n_words long"


def odd_docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    more = (True, "x", 5, 6, 7, 0.5, 8)
    return spark.createDataFrame([r + more for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def empty_docs(spark):
    return odd_docs(spark, []).where("false")


def components(rows, size=5, similarity=75):
    """{doc_id: (set size, smallest linked doc_id)} by all pairs."""
    sets = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets[doc] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(rows, length):
    """{doc_id: (bytes, removed, runs, sha of the rest)} by a set of all strings."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d))))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def measures(text):
    """(words, characters in words, symbols, repeated lines, words in repeated
    windows, lines with a word)."""
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)
