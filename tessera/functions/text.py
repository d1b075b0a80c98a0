"""Text functions as columns: extraction, verifiers, framing, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?s)```(?:\w+)?\n(.*?)```"
INTERACT = r"(?is)<interact>(.*?)</interact>"
INNER = r"(?is)```(?:python)?\n?(.*?)```"


#: White space as Python's own text functions see it: Unicode's and the separators 1c to 1f.
SPACE, VISIBLE = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
_BLANK_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(_col(x), F.lit(_BLANK_CHARS))


def _last(x: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1))


def last_fence(x) -> Column:
    """Content of the last fenced block, stripped; '' without one."""
    return F.coalesce(strip(_last(_col(x), FENCED)), F.lit(""))


def interact_last_pair(x) -> Column:
    """As the evaluator reads it: the last of the tag pairs that match in order,
    with an inner fence unwrapped; null without a pair."""
    inner = _last(_col(x), INTERACT)
    return strip(F.coalesce(_last(inner, INNER), inner))


def interact_last_open(x) -> Column:
    """As the environment reads it: from the last opening tag to the first close
    after it; null if that tag isn't closed."""
    x = _col(x)
    tail = F.regexp_extract(x, r"(?is)^.*<interact>(.*)$", 1)
    closed = F.lower(tail).contains("</interact>") & F.lower(x).contains("<interact>")
    inner = F.regexp_extract(tail, r"(?is)^(.*?)</interact>", 1)
    return F.when(closed, strip(F.coalesce(_last(inner, INNER), inner)))


def close_interact(x) -> Column:
    """Appends the closing tag where only an opening one stands (case counts)."""
    x = _col(x)
    return F.when(x.contains("<interact>") & ~x.contains("</interact>"), F.concat(x, F.lit("</interact>"))).otherwise(x)


# What outputs say.
TRUNCATED = "Output too long, showing only last {} tokens.\n"
NO_OUTPUT = "(no output during interaction -- did you forget to print? did you enclose the code correctly in <interact></interact>?)"
FAILED = "Error: execution failed."


def tail_tokens(x, limit: int) -> Column:
    """The last *limit* tokens (between single spaces) behind a notice, or the text
    itself; a limit below 1 is none."""
    if limit <= 0:
        return _col(x)
    tokens = F.split(_col(x), " ", -1)
    kept = F.array_join(F.slice(tokens, -limit, limit), " ")
    return F.when(F.size(tokens) > limit, F.concat(F.lit(TRUNCATED.format(limit)), kept)).otherwise(_col(x))


def tail_in_frame(x, limit: int) -> Column:
    """The same, but only inside an output frame that makes up the whole text."""
    x = _col(x)
    frame = r"(?s)^<output>\n(.*)</output>\s*$"
    inner = F.regexp_extract(x, frame, 1)
    longer = F.size(F.split(inner, " ", -1)) > limit
    return F.when(x.rlike(frame) & longer & F.lit(limit > 0), F.concat(F.lit("<output>\n"), tail_tokens(inner, limit), F.lit("</output>"))).otherwise(x)


def framed_output(stdout, stderr, ok) -> Column:
    """What a run shows: its output, a note that there was none, or the error."""
    some = lambda c: F.nullif(_col(c), F.lit(""))
    error = F.coalesce(F.concat(F.lit("Error:\n"), some(stderr)), F.lit(FAILED))
    body = F.when(_col(ok), F.coalesce(some(stdout), F.lit(NO_OUTPUT))).otherwise(error)
    return F.concat(F.lit("<output>\n"), body, F.lit("</output>"))


def timed_out(stderr) -> Column:
    return F.coalesce(F.lower(_col(stderr)).contains("timed out"), F.lit(False))


def loose(x) -> Column:
    """Stripped, lower-cased, without spaces and thin spaces."""
    return F.replace(F.replace(F.lower(strip(x)), F.lit(" "), F.lit("")), F.lit("\\,"), F.lit(""))


def loosely_contains(response, target) -> Column:
    return loose(response).contains(loose(target))


def unquoted(x) -> Column:
    """Stripped, with one pair of double quotes around it taken off."""
    s = strip(x)
    return F.when((F.length(s) >= 2) & s.startswith('"') & s.endswith('"'), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def after_think(x) -> Column:
    """What follows a closed thought; '' if one is opened and not closed."""
    x = _col(x)
    return F.when(x.contains("</think>"), strip(F.regexp_extract(x, r"(?s)^.*</think>(.*)$", 1))).when(x.contains("<think>"), "").otherwise(x)


def fenced(x, language: str = "python") -> Column:
    """Puts an answer in a fence unless it begins with one."""
    x = _col(x)
    return F.when(x.startswith("```"), x).otherwise(F.concat(F.lit(f"```{language}\n"), x, F.lit("\n```")))


def preview(x, size: int = 200) -> Column:
    x = _col(x)
    return F.when(F.length(x) > size, F.concat(F.substring(x, F.lit(1), F.lit(size)), F.lit("..."))).otherwise(x)


def resolved_channel(messages, raw) -> Column:
    """(content, channel, analysis) of parsed messages (channel, content): the last
    final text, else commentary, else analysis, else the raw text as unknown. A
    message without a channel is final; analysis is told beside the others only."""
    m = _col(messages)
    last = lambda name: F.nullif(F.try_element_at(F.filter(m, lambda x: F.coalesce(F.nullif(x["channel"], F.lit("")), F.lit("final")) == name), F.lit(-1))["content"], F.lit(""))
    final, comment, thought = last("final"), last("commentary"), last("analysis")
    channel = F.when(final.isNotNull(), "final").when(comment.isNotNull(), "commentary").when(thought.isNotNull(), "analysis").otherwise("unknown")
    beside = F.when(final.isNotNull() | comment.isNotNull(), thought)
    return F.struct(F.coalesce(final, comment, thought, _col(raw), F.lit("")).alias("content"), channel.alias("channel"), beside.alias("analysis"))


def of_family(name, family: str = "gpt-oss") -> Column:
    """Whether a model's name says that it is of a family, in any case."""
    return F.lower(_col(name)).contains(family)


def plain_prompt(problem) -> Column:
    """A problem for a model without a chat template."""
    return F.concat(F.lit("Solve this problem step-by-step: "), _col(problem), F.lit("\n\n Put the final answer within \\boxed{}\n"))


def backoff(base, attempt) -> Column:
    """Seconds to wait before an attempt, doubled each time."""
    return _col(base) * F.pow(F.lit(2.0), _col(attempt))


def id_range(name) -> tuple[Column, Column]:
    """(low, high) from a name that ends in _low_high, else nulls."""
    pattern = r"_(\d+)_(\d+)$"
    part = lambda i: F.regexp_extract(_col(name), pattern, i).try_cast("long")
    return part(1), part(2)


def listed(x) -> Column:
    """Entries of comma-separated text: stripped, no empty ones."""
    return F.filter(F.transform(F.split(_col(x), ","), strip), lambda e: e != "")


def listed_numbers(x) -> Column:
    return F.array_sort(F.transform(listed(x), lambda e: e.try_cast("int")))


# --- instruction verifiers ---------------------------------------------------


def has_no_comma(x) -> Column:
    return ~_col(x).contains(",")


def word_count(x) -> Column:
    return F.size(F.filter(F.split(_col(x), rf"(?U){SPACE}+"), lambda w: w != ""))


def sentence_count(x) -> Column:
    return F.size(F.filter(F.split(_col(x), "[.!?]+"), lambda s: s.rlike(rf"(?U){VISIBLE}")))


def compared(n: Column, relation: Column, bound: Column) -> Column:
    """1 or 0 by a relation that verifiers know; any other is 0. Null without a
    bound that a known one needs."""
    ok = F.when(relation == "at least", n >= bound).when(relation == "at most", n <= bound).when(relation == "less than", n < bound).otherwise(F.lit(False))
    return F.when(ok, 1.0).when(ok.isNotNull(), 0.0)


def keyword_count(x, keyword) -> Column:
    """Non-overlapping occurrences in any case; of the empty word, one at each
    position."""
    word = F.lower(keyword if isinstance(keyword, Column) else F.lit(keyword))
    quoted = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(word == "", F.length(_col(x)) + 1).otherwise(F.regexp_count(F.lower(_col(x)), quoted))


WORDS, SENTENCES = "length_constraints:number_words", "length_constraints:number_sentences"


def instruction_score(x, name: Column, settings: Column, counted: tuple[Column, Column] | None = None) -> Column:
    """1 or 0; 0.5 for an instruction that isn't known or can't be judged. *settings*
    is a map of texts: what is absent takes its default ('at least', 100 words, 3
    sentences, the empty keyword, once); a null relation is none, another null
    setting, or null settings, can't be judged. *counted* has the text's words and
    sentences, if they are known."""
    x = _col(x)
    words, sentences = counted or (word_count(x), sentence_count(x))
    of = lambda key, default: F.when(F.map_contains_key(settings, F.lit(key)), F.try_element_at(settings, F.lit(key))).otherwise(F.lit(default))
    relation = of("relation", "at least")
    number = lambda key, default: of(key, default).try_cast("double")
    seen = keyword_count(x, of("keyword", "")) >= number("frequency", "1")
    score = (
        F.when(name == WORDS, compared(words, relation, number("num_words", "100")))
        .when(name == SENTENCES, compared(sentences, relation, number("num_sentences", "3")))
        .when(name == "keywords:frequency", F.when(seen, 1.0).when(seen.isNotNull(), 0.0))
    )
    return F.when(name == "punctuation:no_comma", F.when(has_no_comma(x), 1.0).otherwise(0.0)).otherwise(F.coalesce(F.when(settings.isNotNull(), score), F.lit(0.5)))


def instruction_reward(x, names: Column, settings: Column) -> Column:
    """Mean score of arrays of names and settings: pairs up to the shorter array,
    over the number of names; 1 without names."""
    pairs = F.slice(F.arrays_zip(names.alias("n"), settings.alias("s")), F.lit(1), F.least(F.size(names), F.size(settings)))
    asked = lambda name, count: F.when(F.array_contains(names, name), count(x))
    counts = F.array(F.struct(asked(WORDS, word_count).alias("words"), asked(SENTENCES, sentence_count).alias("sentences")))  # each once a text
    score = lambda p, c: instruction_score(x, p["n"], p["s"], (c["words"], c["sentences"]))
    total = F.get(F.transform(counts, lambda c: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + score(p, c))), F.lit(0))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, 1.0).otherwise(total / F.size(names))


# --- comparison of outputs ---------------------------------------------------


#: What ends a line.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(strip(x), BREAK), strip), lambda line: line != "")


def match_tier(expected, actual) -> Column:
    """The first way in which two outputs agree: trimmed, the lines that aren't
    blank, the tokens of each such line; null if none. Numbers within a tolerance
    are left to the scorer."""
    a, b = _col(expected), _col(actual)
    one = F.array(F.struct(a.alias("a"), b.alias("b"), _lines(a).alias("x"), _lines(b).alias("y")))  # each side once
    tokens = lambda lines: F.transform(lines, lambda line: F.split(line, rf"(?U){SPACE}+"))
    tier = lambda r: F.when(strip(r["a"]) == strip(r["b"]), "trimmed").when(r["x"] == r["y"], "lines").when(tokens(r["x"]) == tokens(r["y"]), "tokens")
    return F.when(strip(a) == strip(b), "trimmed").otherwise(F.get(F.transform(one, tier), F.lit(0)))  # lines only if they are needed
