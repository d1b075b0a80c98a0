"""Tokenizers and chat templates as columns.

A vocabulary names a library and a file; each Python worker loads it once.  Without
a file there are ``characters``, whose ids are code points.  Templates are plain
expressions; only encoding and decoding leave the JVM, by Arrow batches."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import TRUNCATED


@dataclass(frozen=True)
class Vocabulary:
    """*kind* is characters, tokenizers, tiktoken (with its split *pattern*) or
    sentencepiece; *path* is where every executor finds the file."""

    kind: str = "characters"
    path: str | None = None
    pattern: str | None = None


class _Characters:
    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(ord, x)) for x in texts]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


class _Tokenizers:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def encode(self, texts):
        return [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids):
        return self.library.decode(ids, skip_special_tokens=False)


class _Ranks:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts):
        return [self.library.encode_ordinary(x) for x in texts]

    def decode(self, ids):
        return self.library.decode(ids)


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts):
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids):
        return self.library.decode(ids)


@lru_cache(maxsize=8)
def loaded(vocabulary: Vocabulary):
    """The tokenizer of a vocabulary, once a process."""
    if vocabulary.kind == "characters":
        return _Characters()
    if vocabulary.kind == "tiktoken":
        return _Ranks(vocabulary.path, vocabulary.pattern)
    return {"tokenizers": _Tokenizers, "sentencepiece": _Pieces}[vocabulary.kind](vocabulary.path)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Characters (or ids) that are encoded (or decoded) at a time, unless one text has more.
STEP = 200_000


def _each(texts: pd.Series, made) -> pd.Series:
    """What *made* gives for the texts that aren't null, some of them at a time:
    their ids take many times their room."""
    out, some, size = [None] * len(texts), [], 0

    def settle():
        for i, x in zip(some, made([texts.iat[i] for i in some])):
            out[i] = x

    for i in texts.notna().to_numpy().nonzero()[0].tolist():
        n = len(texts.iat[i])
        if some and size + n > STEP:
            settle()
            some, size = [], 0
        some.append(i)
        size += n
    if some:
        settle()
    return pd.Series(out, index=texts.index, dtype=object)


def token_ids(x, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Ids of a text, without added special tokens; null of null."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return _each(texts, loaded(vocabulary).encode)

    return ids(_col(x))


def token_count(x, vocabulary: Vocabulary = Vocabulary()) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda some: [len(i) for i in loaded(vocabulary).encode(some)])

    return count(_col(x))


def decoded(ids, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The text of ids, special tokens included; null of null."""

    @F.pandas_udf("string")
    def text(arrays: pd.Series) -> pd.Series:
        return _each(arrays, lambda some: [loaded(vocabulary).decode([int(i) for i in x]) for x in some])

    return text(_col(ids))


def tail_by_ids(x, limit: int, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The text of the last *limit* ids behind a notice, or the text itself if it
    has no more; a limit below 1 is none."""
    if limit <= 0:
        return _col(x)

    @F.pandas_udf("string")
    def tail(texts: pd.Series) -> pd.Series:
        tokenizer = loaded(vocabulary)
        shown = lambda text, ids: text if len(ids) <= limit else TRUNCATED.format(limit) + tokenizer.decode(ids[-limit:])
        return _each(texts, lambda some: [shown(t, i) for t, i in zip(some, tokenizer.encode(some))])

    return tail(_col(x))


def tail_in_frame_by_ids(x, limit: int, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The same, but only inside an output frame that makes up the whole text; what
    isn't cut stays as it is, with the white space behind the frame."""
    x = _col(x)
    if limit <= 0:
        return x
    framed = x.rlike(r"(?s)^<output>\n(.*)</output>\s*$")
    inner = F.when(framed, F.regexp_extract(x, r"(?s)^<output>\n(.*)</output>\s*$", 1))
    cut = tail_by_ids(inner, limit, vocabulary)
    return F.when(framed & (cut != inner), F.concat(F.lit("<output>\n"), cut, F.lit("</output>"))).otherwise(x)


@dataclass(frozen=True)
class Template:
    """What stands before and after each message ({role} is its role), and what asks
    for an answer."""

    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    ask: str = "<|assistant|>\n"


def rendered_chat(messages, template: Template = Template(), ask: bool = True) -> Column:
    """Messages (role, content) as a prompt; null contents are empty."""
    left, _, right = template.before.partition("{role}")
    role = (lambda m: F.concat(F.lit(left), m["role"], F.lit(right))) if "{role}" in template.before else lambda m: F.lit(left)
    said = F.transform(_col(messages), lambda m: F.concat(role(m), F.coalesce(m["content"], F.lit("")), F.lit(template.after)))
    return F.concat(F.array_join(said, ""), F.lit(template.ask if ask else ""))


def turn_messages(history, observation, turn, max_turns, final_prompt: str) -> Column:
    """The history and what the user says now: the observation, on the last turn
    (max_turns - 1) followed by the final prompt, which stands alone after an empty
    one."""
    seen = _col(observation)
    last = F.concat(F.when(F.coalesce(seen, F.lit("")) != "", F.concat(seen, F.lit("\n\n"))).otherwise(""), F.lit(final_prompt))
    now = F.when(_col(turn) == _col(max_turns) - 1, last).otherwise(seen)
    return F.concat(_col(history), F.array(F.struct(F.lit("user").alias("role"), now.alias("content"))))


def opening_messages(observation, system: str, developer: str | None = None, effort: str | None = None) -> Column:
    """A record's first messages: system and user; with *developer* instructions, a
    note on the reasoning effort, the instructions and user."""
    said = [("system", system)]
    if developer is not None:
        said = [("system", f"[Harmony format] Reasoning effort: {effort}"), ("developer", developer)]
    rows = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in said]
    return F.array(*rows, F.struct(F.lit("user").alias("role"), _col(observation).alias("content")))
