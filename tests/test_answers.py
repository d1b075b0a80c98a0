"""Symbolic answers, channel markup, tokenizers and templates."""

import base64

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, channels, tokens
from tessera.functions.text import TRUNCATED

EQUAL = [
    (r"so \boxed{\frac{1}{2}}", "0.5"), (r"\boxed{50\%}", "1/2"), (r"\boxed{\frac12}", r"\frac{2}{4}"), (r"\boxed{\dfrac{-3}{4}}", "-0.75"),
    (r"\boxed{\sqrt{8}}", r"2\sqrt{2}"), (r"\boxed{\frac{1}{\sqrt2}}", r"\frac{\sqrt{2}}{2}"), (r"\boxed{\frac{1}{1+\sqrt{2}}}", r"\sqrt2-1"),
    (r"\boxed{(1, \frac{2}{4})}", "(1,0.5)"), (r"\boxed{\{3,1\}}", r"\{1,3\}"), (r"\boxed{2, 3}", "3, 2"), (r"\boxed{[0,1)}", "[0, 1)"),
    ("1,234", "1234"), ("x = 5", "5"), ("so x = 5", "5"), (r"\boxed{1\frac{1}{2}}", "3/2"), (r"\boxed{0.333333}", r"\frac13"), (r"\boxed{Blue}", "blue"),
    (r"\boxed{2^{10}}", "1024"), (r"\boxed{2^{-1}}", "0.5"), (r"\boxed{4^{1/2}}", "2"), (r"3\times 10^2", "300"), (r"\boxed{90^\circ}", "90"),
    (r"\boxed{a} then \boxed{7}", "7"), (r"\boxed{7} then \boxed{8", "7"), (r"\boxed{5.}", "5"), (r"\boxed{.5}", "1/2"), (r"\boxed{\text{m} 5}", "5"),
    ("The answer is 12.", "12"), ("it is $x$ or $\\frac{6}{4}$ then", "1.5"), ("the answer is cat", "cat"), (r"\boxed{\left(2,\ 3\right)}", "(2,3)"), (r"\boxed{\sqrt{12}+\sqrt{27}}", r"5\sqrt3"),
]
UNEQUAL = [
    (r"\boxed{0.333}", r"\frac13"), (r"\boxed{[0,1)}", "(0,1)"), (r"\boxed{(2,1)}", "(1,2)"), (r"\boxed{\sqrt{3}}", "1.7"), (r"\boxed{1/0}", "1"), (r"\boxed{}", "1"),
    (r"\boxed{12}", "1,2"), (r"\boxed{2}", "the set 2 and 3"), (r"\boxed{\{1,1\}}", r"\{1,2\}"), ("15", "5"), (r"\boxed{5}", "cat"), (None, "1"), ("1", None), (r"\boxed{cat}", "the cat"),
    (r"\boxed{9^{99999999}}", "1"), (r"\boxed{" + "{" * 3000 + "}", "1"), ("(" * 5000, "1"), (r"\boxed{\sqrt{-4}}", "2"), (r"\boxed{2^{\sqrt2}}", "2"),
]


@pytest.mark.parametrize("response, target", EQUAL)
def test_equal_answers(response, target):
    assert answers.answers_agree(response, target)


@pytest.mark.parametrize("response, target", UNEQUAL)
def test_unequal_answers(response, target):
    assert not answers.answers_agree(response, target)


def test_last_boxed():
    assert answers.last_boxed(r"\boxed{a{b}c} \boxed{open") == "a{b}c" and answers.last_boxed("none") is None
    assert answers.last_boxed(r"\boxed {x\}y}") == r"x\}y"


def test_answers_as_columns(spark):
    df = spark.createDataFrame([(r"\boxed{\frac{1}{2}}", ".5"), (None, "1"), ("", "")], "r string, t string")
    got = [tuple(r) for r in df.select(answers.answer_agrees("r", "t"), answers.boxed("r")).collect()]
    assert got == [(True, r"\frac{1}{2}"), (False, None), (False, None)]


MARKED = [
    ("plain", True, []),
    ("", True, []),
    ("<|channel|>final<|message|>hi", False, [("assistant", "final", None, "hi")]),
    ("<|message|>hi<|end|>", False, [("assistant", None, None, "hi")]),
    ("final<|message|>hi<|end|>", False, [("assistant", "final", None, "hi")]),
    ("<|channel|>analysis<|message|>a\n<b><|end|>\n<|start|>assistant<|channel|>final<|message|><|return|>", False, [("assistant", "analysis", None, "a\n<b>"), ("assistant", "final", None, "")]),
    ("<|start|>tool to=assistant<|channel|>commentary<|message|>x<|end|><|start|>user<|message|>y", False, [("tool", "commentary", "assistant", "x"), ("user", None, None, "y")]),
    ("<|channel|>commentary to=functions.f <|constrain|>json<|message|>{}<|call|>", False, [("assistant", "commentary", "functions.f", "{}")]),
    ("<|channel|>analysis<|message|>a<|channel|>final<|message|>b", False, [("assistant", "analysis", None, "a"), ("assistant", "final", None, "b")]),
    ("<|channel|>final<|message|>hi<|end|>more", True, []),
    ("<|channel|>fin", True, []),
    ("<|channel|>final<|message|>hi<|end|><|start|>assis", True, []),
]


def test_markup(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(MARKED)] + [(99, None)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", channels.parsed_markup("t").alias("p"), channels.read_answer("t").alias("a")).collect()}
    for i, (text, error, want) in enumerate(MARKED):
        assert (got[i]["p"]["parse_error"], [tuple(m) for m in got[i]["p"]["messages"]]) == (error, want), text
        if error:
            assert tuple(got[i]["a"]) == (text, "parse_error", None)
    assert got[99]["p"] is None and got[99]["a"] is None
    assert tuple(got[5]["a"])[1:] == ("analysis", None)  # an empty final text isn't an answer
    assert tuple(got[8]["a"]) == ("b", "final", "a")


TEXTS = ["", "one two  three\n\n four's 12345", "ünd 中文 😀 " * 40, "x" * 500, "<|endoftext|> tail " * 9, None]


def vocabularies():
    public = pytest.importorskip("public_tokenizers")
    return [
        tokens.Vocabulary(),
        tokens.Vocabulary("tokenizers", public.path("byte_bpe_50k.json")),
        tokens.Vocabulary("tokenizers", public.path("word_bpe_49k.json")),
        tokens.Vocabulary("tiktoken", public.path("byte_bpe_50k.tiktoken"), public.PATTERN),
        tokens.Vocabulary("sentencepiece", public.path("piece_bpe_32k.model")),
    ]


def by_library(v):
    """(encode, decode) of the library itself."""
    if v.kind == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(v.path)
        return (lambda x: t.encode(x, add_special_tokens=False).ids), (lambda i: t.decode(i, skip_special_tokens=False))
    if v.kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(v.path, "rb"))}
        t = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
        return t.encode_ordinary, t.decode
    if v.kind == "sentencepiece":
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=v.path)
        return t.encode, t.decode
    return (lambda x: [ord(c) for c in x]), (lambda i: "".join(map(chr, i)))


@pytest.mark.parametrize("k", range(5))
def test_tails_equal_the_library(spark, k):
    v = vocabularies()[k]
    encode, decode = by_library(v)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("o", F.concat(F.lit("<output>\n"), "t", F.lit("</output> \n")))
    rows = {r["i"]: r for r in df.select("i", tokens.token_ids("t", v).alias("ids"), tokens.token_count("t", v).alias("n"), tokens.tail_by_ids("t", 7, v).alias("tail"), tokens.tail_in_frame_by_ids("o", 7, v).alias("framed"), tokens.decoded(tokens.token_ids("t", v), v).alias("back")).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert tuple(rows[i])[1:] == (None,) * 5
            continue
        ids = encode(t)
        tail = t if len(ids) <= 7 else TRUNCATED.format(7) + decode(ids[-7:])
        assert rows[i]["ids"] == ids and rows[i]["n"] == len(ids) and rows[i]["tail"] == tail and rows[i]["back"] == decode(ids)
        assert rows[i]["framed"] == (f"<output>\n{tail}</output>" if tail != t else f"<output>\n{t}</output> \n")


def test_templates(spark):
    said = "array(struct('system' as role, 'S' as content), struct('user' as role, null as content))"
    df = spark.sql(f"SELECT {said} AS m, 'seen' AS o")
    chat = tokens.Template("<<{role}>>", "|", "?")
    row = df.select(
        tokens.rendered_chat("m", chat).alias("a"), tokens.rendered_chat("m", chat, ask=False).alias("b"),
        tokens.turn_messages("m", "o", F.lit(4), F.lit(5), "END").alias("c"), tokens.turn_messages("m", F.lit(""), F.lit(4), F.lit(5), "END").alias("d"),
        tokens.turn_messages("m", "o", F.lit(3), F.lit(5), "END").alias("e"), tokens.tail_by_ids("o", 0).alias("f"),
    ).first()
    assert row["a"] == "<<system>>S|<<user>>|?" and row["b"] == "<<system>>S|<<user>>|" and row["f"] == "seen"
    assert [row[k][-1]["content"] for k in "cde"] == ["seen\n\nEND", "END", "seen"]


def test_white_space_is_pythons(spark):
    from tessera.functions import text

    texts = ["a \x1c", "\x1d\u2003a\x1f", "a\x1fb", "  ", "a\x85"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.strip("t"), text.word_count("t"), text.match_tier("t", F.lit("a b"))).orderBy("i").collect()
    assert [r[1] for r in got] == [t.strip() for t in texts] and [r[2] for r in got] == [len(t.split()) for t in texts]
    assert got[2][3] == "tokens"


def test_short_forms_are_kept_and_braces_may_be_escaped():
    answers._kept.cache_clear()
    for _ in range(50):
        assert answers.answers_agree("so \\boxed{\\frac{1}{2}}", "0.5") and not answers.answers_agree("\\boxed{2}", "0.5")
    assert answers._kept.cache_info().misses == 3
    assert answers.answers_agree("1" * 150, "1" * 150) and answers._kept.cache_info().misses == 3  # too long to keep
    assert answers.last_boxed("\\boxed {a\\}b{c}\\{} \\boxed{open") == "a\\}b{c}\\{"
    assert answers.last_boxed("\\boxed{") is None and answers.last_boxed("\\boxedx") is None


def test_a_marked_up_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("<|channel|>final<|message|>a\ue001b<|end|>",)], "t string")
    plan = df.select(channels.parsed_markup("t").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)^(.*?)") == 3
    plan = df.select(channels.read_answer("t").alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)^(.*?)") == 3


def test_texts_are_encoded_some_at_a_time(monkeypatch):
    import pandas as pd

    seen = []
    monkeypatch.setattr(tokens, "STEP", 10)
    texts = pd.Series(["a" * 4, None, "b" * 4, "c" * 30, "", "d" * 4], index=range(5, 11))
    got = tokens._each(texts, lambda some: seen.append(sum(map(len, some))) or [x.upper() for x in some])
    assert got.tolist() == [None if t is None else t.upper() for t in texts] and list(got.index) == list(texts.index)
    assert seen == [8, 30, 4]
