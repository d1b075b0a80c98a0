"""JSON and arrays as columns."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def parsed(text, schema: str, on_error: str = "null", empty: Column | None = None) -> Column:
    """JSON text as *schema*. On text that isn't JSON: null, 'empty' (the given
    value), or 'raise'."""
    c = F.col(text) if isinstance(text, str) else text
    if on_error == "raise":
        return F.from_json(c, schema, {"mode": "FAILFAST"})
    value = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))  # else a struct of nulls
    return F.coalesce(value, empty) if on_error == "empty" else value


def parsed_or_raw(text, schema: str) -> Column:
    """(value, raw): JSON text as *schema*, or the text itself where it isn't JSON."""
    c = F.col(text) if isinstance(text, str) else text
    ok = F.try_parse_json(c).isNotNull()
    return F.struct(F.when(ok, F.from_json(c, schema)).alias("value"), F.when(~ok, c).alias("raw"))


def serialised(df, *columns: str):
    """Nested columns as JSON text, as tables at rest have them."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def mean_of_nested(rewards) -> Column:
    """Mean over lists of lists, null without any entry."""
    flat = F.flatten(F.col(rewards) if isinstance(rewards, str) else rewards)
    return F.try_divide(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), F.size(flat))


def test_cases(public, private) -> tuple[Column, Column]:
    """(inputs, outputs) of public then private cases, arrays of structs with
    input and output. Private cases must have been parsed from JSON: packed
    binary forms are never unpickled, so they are null here."""
    cases = F.concat(F.coalesce(public, F.array().cast("array<struct<input:string,output:string>>")), F.coalesce(private, F.array().cast("array<struct<input:string,output:string>>")))
    return F.transform(cases, lambda x: x["input"]), F.transform(cases, lambda x: x["output"])


def each_json(values: Column) -> Column:
    """JSON text of each entry by itself."""
    return F.transform(values, lambda x: F.to_json(F.struct(x.alias("v"))))


def joined_lines(values: Column) -> Column:
    return F.array_join(values, "\n")


@F.pandas_udf(StringType())
def integer_keys(texts: pd.Series) -> pd.Series:
    """JSON text of one object, or a list of one, whose keys are digits: keys
    become integers, written as a Python literal. Other text stays."""

    def fix(text):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            return text
        listed = isinstance(value, list) and len(value) == 1
        inner = value[0] if listed else value
        if not isinstance(inner, dict) or not inner or not all(k.lstrip("-").isdigit() for k in inner):
            return text
        inner = {int(k): v for k, v in inner.items()}
        return repr([inner] if listed else inner)

    return texts.map(fix)


@F.pandas_udf(ArrayType(StringType()))
def literals(texts: pd.Series) -> pd.Series:
    """Each non-blank line of a text as the JSON of the Python literal that it is;
    null for a line that is none. Nothing is evaluated but literals."""

    def one(line: str):
        try:
            return json.dumps(ast.literal_eval(line))
        except (ValueError, SyntaxError, TypeError):
            return None

    def lines(text) -> Iterator[str]:
        return [one(x) for x in (text or "").split("\n") if x.strip()]

    return texts.map(lines)


@F.pandas_udf(StringType())
def without_main(texts: pd.Series) -> pd.Series:
    """Program text without its ``if __name__ == "__main__"`` block: from that line
    to the next line that isn't blank and no deeper than it."""

    def cut(text):
        if text is None:
            return None
        kept, depth = [], None
        for line in text.split("\n"):
            indent = len(line) - len(line.lstrip())
            if depth is not None:
                if not line.strip() or indent > depth:
                    continue
                depth = None
            head = line.strip().replace("'", '"')
            if head.startswith("if __name__") and '"__main__"' in head:
                depth = indent
                continue
            kept.append(line)
        return "\n".join(kept)

    return texts.map(cut)
