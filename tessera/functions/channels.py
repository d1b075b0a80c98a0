"""Answers marked up by channels.

An answer is a row of messages: ``<|start|>role<|channel|>name<|message|>text`` up
to ``<|end|>``, ``<|return|>`` or ``<|call|>``.  The first may begin within its
header, as the asker's role stood before it.  The reader is tolerant: a message may
lack its start, its role, its channel or its end.  What has no message at all, a
last header that is cut off, and text between messages make a parse error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import resolved_channel

# The markers and the roles.
START, CHANNEL, MESSAGE = r"<\|start\|>", r"<\|channel\|>", r"<\|message\|>"
OVER = r"<\|(?:end|return|call)\|>"
ROLES = ("assistant", "user", "system", "developer", "tool")

_MESSAGE = rf"(?s)^(.*?){MESSAGE}(.*?)(?:{OVER}(.*))?$"
#: Characters that stand for a message's start and the end of its role while a text
#: is read; a text's own are taken out of its headers only.
_FROM, _ROLE = "\ue000", "\ue001"


def _with(value: Column, made) -> Column:
    """What *made* gives for a value that is worked out once, however often it's used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _chunks(x: Column) -> Column:
    """One text for each message: role, _ROLE, rest."""
    marked = F.regexp_replace(x, rf"{START}([^<]*){CHANNEL}", f"{_FROM}$1{_ROLE}")
    marked = F.regexp_replace(marked, rf"{START}([^<]*){MESSAGE}", f"{_FROM}$1{_ROLE}<|message|>")
    # a channel without a start begins a message of the asker's role
    marked = F.regexp_replace(marked, CHANNEL, f"{_FROM}assistant{_ROLE}")
    marked = F.regexp_replace(marked, START, _FROM)
    return F.filter(F.transform(F.split(marked, _FROM, -1), lambda c: c), lambda c: ~c.rlike(r"^\s*$"))


def parsed_markup(x) -> Column:
    """struct(messages: array of (role, channel, recipient, content), parse_error).
    Null stays null. A role that isn't known is the assistant's, a missing channel
    null; a message that lacks its end goes on to the next one's start or the end."""
    x = F.col(x) if isinstance(x, str) else x
    safe = F.regexp_replace(x, f"[{_FROM}{_ROLE}]", "")

    def parted(chunk: Column) -> Column:
        at = F.instr(chunk, _ROLE)
        return F.when(at > 0, F.struct(F.substring(chunk, F.lit(1), at - 1).alias("role_part"), F.substring(chunk, at + 1, F.length(chunk)).alias("rest"))).otherwise(F.struct(F.lit("assistant").alias("role_part"), chunk.alias("rest")))

    def matched(p: Column) -> Column:
        rest = p["rest"]
        return F.struct(p["role_part"].alias("role_part"), F.regexp_extract(rest, _MESSAGE, 1).alias("head"), F.regexp_extract(rest, _MESSAGE, 2).alias("content"), (rest.contains("<|message|>") & F.regexp_extract(rest, _MESSAGE, 3).rlike(r"^\s*$")).alias("whole"))

    def one(p: Column) -> Column:
        role_part, head = p["role_part"], p["head"]
        word = F.regexp_extract(role_part, r"^\s*(\S*)", 1)
        name = F.regexp_extract(head, r"^\s*([^\s<]*)", 1)
        to = F.regexp_extract(F.concat(role_part, F.lit(" "), head), r"\bto=([^\s<]+)", 1)
        return F.struct(
            F.when(word.isin(*ROLES), word).otherwise("assistant").alias("role"),
            F.when(~name.startswith("to="), F.nullif(name, F.lit(""))).alias("channel"),
            F.nullif(to, F.lit("")).alias("recipient"),
            p["content"].alias("content"),
            p["whole"].alias("whole"),
        )

    def told(read: Column) -> Column:
        error = (F.size(read) == 0) | F.exists(read, lambda m: ~m["whole"])
        messages = F.transform(read, lambda m: F.struct(m["role"], m["channel"], m["recipient"], m["content"]))
        return F.struct(F.when(error, F.slice(messages, 1, 0)).otherwise(messages).alias("messages"), error.alias("parse_error"))

    read = F.transform(F.transform(F.transform(_chunks(safe), parted), matched), one)
    return F.when(x.isNotNull(), _with(read, told))


def read_answer(x) -> Column:
    """struct(content, channel, analysis) of a marked-up answer: the last final
    text, else commentary, else analysis, else the whole text as unknown; the whole
    text as parse_error where it can't be read."""
    x = F.col(x) if isinstance(x, str) else x
    return _with(parsed_markup(x), lambda read: answer_of(read, x))


def answer_of(read, x) -> Column:
    """The same, of a text that has been parsed already."""
    read, x = (F.col(c) if isinstance(c, str) else c for c in (read, x))
    failed = F.struct(x.alias("content"), F.lit("parse_error").alias("channel"), F.lit(None).cast("string").alias("analysis"))
    return F.when(read["parse_error"], failed).when(x.isNotNull(), resolved_channel(read["messages"], x))
