"""Equality of short mathematical answers.

The last boxed content of a response (braces balanced), or the response itself, and
the target are brought to a canonical form: sums of rational multiples of square
roots, exactly, in tuples, sets and intervals.  Where either side has a decimal
point, numbers agree to six places.  What isn't in that small language is compared
as loose text."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places to which numbers agree, where one is a decimal.
PLACES = 6
#: Canonical forms that a worker keeps, of texts of so many characters or fewer.
KEPT, KEPT_CHARS = 20_000, 100
#: Digits of a number, and of an exponent's value, beyond which text is text.
LONGEST, HIGHEST = 200, 64

_NOISE = re.compile(r"\\left|\\right|\\[!,;: ]|\\(?:displaystyle|textstyle)|\\text\{[^{}]*\}|\\mathrm\{[^{}]*\}|\$|\^\{?\\circ\}?|°|\\%(?=\\%)")
_BRACES = re.compile(r"(?<!\\)[{}]")
_NAMES = re.compile(r"\\[dtc]frac")
_TOKEN = re.compile(r"\s*(\\frac|\\sqrt|\\cdot|\\times|\\div|\\pm|\\%|\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+\.\d*|\.\d+|\d+|.)", re.S)


def last_boxed(text: str) -> str | None:
    """Content of the last closed ``\\boxed{...}``, braces balanced."""
    at = text.rfind("\\boxed")
    while at >= 0:
        begin = at + len("\\boxed")
        while begin < len(text) and text[begin] == " ":
            begin += 1
        if begin < len(text) and text[begin] == "{":
            depth = 0
            for brace in _BRACES.finditer(text, begin):
                depth += 1 if brace[0] == "{" else -1
                if not depth:
                    return text[begin + 1 : brace.start()]
        at = text.rfind("\\boxed", 0, at)
    return None


class Sum:
    """A sum of rational multiples of square roots of square-free integers."""

    def __init__(self, parts: dict[int, Fraction], decimal: bool = False):
        self.parts, self.decimal = {k: v for k, v in parts.items() if v}, decimal

    def plus(self, other: Sum, sign: int = 1) -> Sum:
        parts = dict(self.parts)
        for k, v in other.parts.items():
            parts[k] = parts.get(k, 0) + sign * v
        return Sum(parts, self.decimal or other.decimal)

    def times(self, other: Sum) -> Sum:
        out = Sum({}, self.decimal or other.decimal)
        for a, x in self.parts.items():
            for b, y in other.parts.items():
                out = out.plus(root(Fraction(a * b)).scaled(x * y))
        return out

    def scaled(self, by: Fraction) -> Sum:
        return Sum({k: v * by for k, v in self.parts.items()}, self.decimal)

    def over(self, other: Sum) -> Sum:
        if len(other.parts) == 2 and 1 in other.parts:  # by the conjugate
            a, (k, b) = other.parts[1], next((k, v) for k, v in other.parts.items() if k != 1)
            return self.times(Sum({1: a, k: -b}, other.decimal)).scaled(1 / (a * a - b * b * k))
        if len(other.parts) != 1:
            raise ValueError("no quotient")
        (k, v), = other.parts.items()
        return Sum(self.times(Sum({k: Fraction(1)})).scaled(1 / (v * k)).parts, self.decimal or other.decimal)

    def rational(self) -> Fraction:
        if set(self.parts) - {1}:
            raise ValueError("not rational")
        return self.parts.get(1, Fraction(0))

    def equals(self, other: Sum) -> bool:
        if self.parts == other.parts:
            return True
        if not (self.decimal or other.decimal):
            return False
        places = Fraction(10) ** PLACES
        near = [round(sum(v * Fraction(isqrt(k * 10**60), 10**30) for k, v in s.parts.items()) * places) for s in (self, other)]
        return near[0] == near[1]


def root(x: Fraction) -> Sum:
    """Its square root, the squares of small factors taken out."""
    if x < 0:
        raise ValueError("no real root")
    n, out, k = x.numerator * x.denominator, Fraction(1, x.denominator), 2
    whole = isqrt(n)
    if whole * whole == n:
        return Sum({1: out * whole})
    while k * k <= n and k < 10_000:
        while n % (k * k) == 0:
            n, out = n // (k * k), out * k
        k += 1
    return Sum({n: out})


class _Reader:
    """Reads one expression, or raises ValueError."""

    def __init__(self, text: str):
        self.tokens, self.at = [t for t in _TOKEN.findall(text) if t.strip()], 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, token: str | None = None) -> str:
        t = self.peek()
        if not t or token is not None and t != token:
            raise ValueError(t)
        self.at += 1
        return t

    def sum(self) -> Sum:
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        out = self.product().scaled(Fraction(sign))
        while self.peek() in ("+", "-"):
            out = out.plus(self.product(), 1) if self.take() == "+" else out.plus(self.product(), -1)
        return out

    def product(self) -> Sum:
        out = self.power()
        while True:
            t = self.peek()
            if t in ("*", "\\cdot", "\\times"):
                self.take()
                out = out.times(self.power())
            elif t in ("/", "\\div"):
                self.take()
                out = out.over(self.power())
            elif t in ("%", "\\%"):
                self.take()
                out = out.scaled(Fraction(1, 100))
            elif t in ("(", "\\sqrt", "\\frac", "{") or t[:1].isdigit():
                mixed = t == "\\frac" and self.tokens[self.at - 1].isdigit()  # one and a half
                out = out.plus(self.power()) if mixed else out.times(self.power())
            else:
                return out

    def power(self) -> Sum:
        out = self.atom()
        if self.peek() == "^":
            self.take()
            n = (self.group() if self.peek() == "{" else self.atom()).rational()
            if n.denominator == 2 and abs(n) <= HIGHEST:
                out, n = root(out.rational()), Fraction(n.numerator)
            if n.denominator != 1 or abs(n) > HIGHEST:
                raise ValueError("no such power")
            base = out
            out = Sum({1: Fraction(1)}, base.decimal)
            for _ in range(abs(int(n))):
                out = out.times(base)
            if n < 0:
                out = Sum({1: Fraction(1)}).over(out)
        return out

    def group(self) -> Sum:
        close = {"{": "}", "(": ")"}[self.take()]
        out = self.sum()
        self.take(close)
        return out

    def argument(self) -> Sum:
        """A group, or the next digit alone."""
        if self.peek() == "{":
            return self.group()
        t = self.take()
        if not t.isdigit():
            raise ValueError(t)
        if len(t) > 1:
            self.at -= 1
            self.tokens[self.at] = t[1:]
        return Sum({1: Fraction(int(t[0]))})

    def atom(self) -> Sum:
        t = self.peek()
        if t in ("{", "("):
            return self.group()
        self.take()
        if t == "\\frac":
            return self.argument().over(self.argument())
        if t == "\\sqrt":
            return root(self.argument().rational())
        number = t.replace(",", "")
        if t[0] in "0123456789." and len(t) > (t == ".") and len(t) <= LONGEST:
            return Sum({1: Fraction(number if number[-1] != "." else number[:-1])}, "." in number.rstrip("."))
        raise ValueError(t)


def _split(text: str) -> list[str]:
    """Entries between commas at depth 0."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def canonical(text: str):
    """(kind, entries): number; tuple, open or closed at each end; set; or text."""
    text = _NAMES.sub(r"\\frac", _NOISE.sub(" ", text)).replace("\\{", "⟨").replace("\\}", "⟩").strip().rstrip(".").strip()
    head, sign, tail = text.rpartition("=")
    if sign and re.fullmatch(r"[\sA-Za-z(),]+", head):  # x = 5
        text = tail.strip()
    try:
        return "number", [_whole(text)]
    except (ValueError, ZeroDivisionError, RecursionError):
        pass
    if len(text) > 1 and (text[0] in "([" and text[-1] in ")]" or text[0] == "⟨" and text[-1] == "⟩"):
        entries = _split(text[1:-1])
        if len(entries) > 1 or text[0] == "⟨":
            kind = "set" if text[0] == "⟨" else text[0] + text[-1]
            return kind, [canonical(x) for x in entries]
    entries = _split(text)
    if len(entries) > 1:
        return "set", [canonical(x) for x in entries]
    return "text", [re.sub(r"\s+", "", text).lower()]


_kept = lru_cache(maxsize=KEPT)(canonical)


def form_of(text: str):
    """The canonical form, kept if the text is short: answers to a problem recur."""
    return _kept(text) if len(text) <= KEPT_CHARS else canonical(text)


def _whole(text: str) -> Sum:
    reader = _Reader(text)
    out = reader.sum()
    if reader.peek():
        raise ValueError(reader.peek())
    return out


def _same(a, b) -> bool:
    (kind, x), (other, y) = a, b
    if kind != other or len(x) != len(y):
        return False
    if kind == "number":
        return x[0].equals(y[0])
    if kind == "text":
        return x == y
    if kind != "set":
        return all(map(_same, x, y))
    left = list(y)
    for one in x:
        found = next((k for k, two in enumerate(left) if _same(one, two)), None)
        if found is None:
            return False
        left.pop(found)
    return True


def last_expression(text: str) -> str:
    """What stands between the last dollar signs, else the last number."""
    told = re.findall(r"\$([^$]+)\$", text) or re.findall(r"(?<![\w.])[-+]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:/\d+)?%?", text)
    return told[-1] if told else text


def answers_agree(response: str | None, target: str | None) -> bool:
    """Whether a response's last boxed content, or else the response or its last
    expression, is the target; null and blank targets are never met. Text that isn't mathematical agrees if it's the same but
    for case and white space; without a box, also if the response holds it."""
    if response is None or target is None or not target.strip():
        return False
    boxed = last_boxed(response)
    given, wanted = form_of(boxed if boxed is not None else response), form_of(last_boxed(target) or target)
    if _same(given, wanted) or boxed is None and _same(form_of(last_expression(response)), wanted):
        return True
    return boxed is None and given[0] == "text" and wanted[0] == "text" and bool(wanted[1][0]) and wanted[1][0] in given[1][0]


def answer_agrees(response, target) -> Column:
    @F.pandas_udf("boolean")
    def agree(responses: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([answers_agree(r, t) for r, t in zip(responses, targets)], index=responses.index, dtype=bool)

    return agree(*(F.col(x) if isinstance(x, str) else x for x in (response, target)))


def boxed(x) -> Column:
    """The last boxed content; null without one."""

    @F.pandas_udf("string")
    def content(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: last_boxed(t) if t is not None else None)

    return content(F.col(x) if isinstance(x, str) else x)
