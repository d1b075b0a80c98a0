"""Queries on texts and conversations, each with SQL of another formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import messages, responses, trajectories
from tessera.functions import answers, channels, nested, text, tokens
from tessera.functions.numbers import rounded
from tessera.operators import environment, scores, turns
from tessera.plans.registry import query
from tessera.plans.rollouts import T
from tessera.sources.tables import table

M = "WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"
R = """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'solve' END AS fn_name, CASE doc_id % 6
    WHEN 0 THEN concat(f, 'python', n, text, n, f) WHEN 1 THEN concat('Plan', n, f, n, 'first', n, f, n, 'then', n, f, 'py', n, text, n, f)
    WHEN 2 THEN concat('<interact>', CASE WHEN doc_id % 12 = 2 THEN concat(f, 'Python', n, 'print(1)', n, f) ELSE 'print(1)' END, '</interact>', n, f, 'python', n, text, n, f)
    WHEN 3 THEN concat('<interact></interact>', n, f, 'python', n, 'class Solution: pass', n, text, n, f)
    WHEN 4 THEN text ELSE concat(f, 'c++', n, text, n, f, n, 'after') END AS response FROM (SELECT *, repeat(chr(96), 3) AS f, chr(10) AS n FROM documents))"""
_FENCES = "regexp_extract_all(response, '(?s)' || repeat(chr(96), 3) || '(?:\\w+)?\\n(.*?)' || repeat(chr(96), 3), 1)"
_TAGS = "regexp_extract_all(response, '(?is)<interact>(.*?)</interact>', 1)"
_INNER = "coalesce(regexp_extract_all({0}, '(?is)' || repeat(chr(96), 3) || '(?:python)?\\n?(.*?)' || repeat(chr(96), 3), 1)[-1], {0})"
_STRIP = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"{M} SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, messages[i].role AS role, messages[i].content AS content FROM m, (SELECT unnest(range(1, 100)) AS i) WHERE i <= len(messages)")
def messages_to_turns(spark, d):
    return messages(spark, d).select("conv_id", F.posexplode("messages").alias("pos", "m")).select("conv_id", "pos", "m.role", "m.content")


@query("SELECT c.conv_id, a.answer FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a USING (conv_id)")
def last_assistant(spark, d):
    return messages(spark, d).select("conv_id", turns.last_assistant().alias("answer"))


@query(f"{M} SELECT conv_id, CAST(n AS INTEGER) AS n, CAST(len(messages[1:2 * n + 2]) AS INTEGER) AS kept, messages[1:2 * n + 2][-1].role AS last_role FROM m, (SELECT unnest([1, 2, 3]) AS n)")
def turn_truncate(spark, d):
    kept = turns.first_turns("messages", F.col("n"))
    return messages(spark, d).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("conv_id", "n", F.size(kept).alias("kept"), F.try_element_at(kept, F.lit(-1))["role"].alias("last_role"))


@query(
    f"""{T}, e AS (SELECT *, n AS requested_turn, num_turns <= n AS done, CASE WHEN num_turns <= n THEN final_reward ELSE rescored_reward END AS new FROM t, (SELECT unnest([1, 3, 5, 8]) AS n))
    SELECT CAST(requested_turn AS INTEGER) AS requested_turn, count(*) AS total_trajectories, count(DISTINCT problem_id) AS unique_problems, count(*) FILTER (done) AS already_complete, count(*) FILTER (NOT done) AS needed_inference,
    round(sum(final_reward) / count(*), 8) AS mean_reward_original, round(sum(new) / count(*), 8) AS mean_reward_new, count(*) FILTER (final_reward > 0) AS successes_original, count(*) FILTER (new > 0) AS successes_new,
    count(*) FILTER (done AND new > 0) AS successes_already_complete, count(*) FILTER (NOT done AND new > 0) AS successes_terminated FROM e GROUP BY requested_turn"""
)
def early_term_metrics(spark, d):
    return turns.early_termination(trajectories(spark, d), [1, 3, 5, 8], "rescored_reward")


_CHANNEL = "CASE WHEN role = 'assistant' THEN CASE WHEN (conv_id + turn) % 3 = 0 THEN 'analysis' ELSE 'final' END END"


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, {_CHANNEL} AS channel FROM conversations), a AS (SELECT conv_id, turn, channel, lead(channel) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM c WHERE role = 'assistant')
    SELECT conv_id, turn, role, channel FROM c WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM a WHERE channel = 'analysis' AND nxt = 'final')"""
)
def drop_analysis_lookahead(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    channel = F.when(F.col("role") == "assistant", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "analysis").otherwise("final"))
    return turns.without_overtaken_analysis(c.withColumn("channel", channel))


@query(
    f"""{M}, q AS (SELECT conv_id, messages, messages[1].content AS q, repeat('=', 80) AS r, chr(10) AS n, repeat(chr(9472), 80) AS thin FROM m)
    SELECT conv_id, concat(r, n, 'Question: ', CASE WHEN length(q) > 50 THEN substr(q, 1, 50) || '...' ELSE q END, n, 'Reward: ', printf('%.2f', conv_id % 3 * 0.25), ' | Turns: ', len(messages), ' | Terminated: ', CASE WHEN conv_id % 2 = 0 THEN 'True' ELSE 'False' END, ' | Truncated: False', n, r,
    array_to_string(list_transform(messages, lambda x: concat(n, n, '[', upper(x.role), ']', n, x.content)), ''),
    CASE WHEN conv_id % 2 = 0 THEN concat(n, n, thin, n, 'Code Interactions (1):', n, '  [1] Code:', n, 'print(1)', n, '  Output:', n, '1') ELSE '' END) AS rendered FROM q"""
)
def render_header(spark, d):
    m = messages(spark, d).withColumn("q", F.get("messages", F.lit(0))["content"])
    even = F.col("conv_id") % 2 == 0
    runs = F.when(even, F.array(F.struct(F.lit("print(1)").alias("code"), F.lit("1").alias("output"))))
    return m.select("conv_id", turns.rendered("q", "messages", runs, F.col("conv_id") % 3 * 0.25, F.size("messages"), even, F.lit(False)).alias("rendered"))


@query(f"{R} SELECT doc_id, coalesce({_STRIP.format(f'({_FENCES})[-1]')}, '') AS code FROM r")
def extract_fence(spark, d):
    return responses(spark, d).select("doc_id", text.last_fence("response").alias("code"))


@query(f"{R} SELECT doc_id, {_STRIP.format(_INNER.format(f'({_TAGS})[-1]'))} AS block FROM r")
def extract_interact(spark, d):
    return responses(spark, d).select("doc_id", text.interact_last_pair("response").alias("block"))


@query(
    f"""{R}, s AS (SELECT doc_id, string_split(response, '<interact>') AS p FROM r)
    SELECT doc_id, CASE WHEN len(p) > 1 AND contains(p[-1], '</interact>') THEN {_STRIP.format(_INNER.format("string_split(p[-1], '</interact>')[1]"))} END AS block FROM s"""
)
def extract_interact_env(spark, d):
    return responses(spark, d).select("doc_id", text.interact_last_open("response").alias("block"))


@query(
    f"""{R}, x AS (SELECT doc_id, fn_name, coalesce({_STRIP.format(f'({_TAGS})[-1]')}, '') AS b, coalesce({_STRIP.format(f'({_FENCES})[-1]')}, '') AS c FROM r)
    SELECT doc_id, CASE WHEN b <> '' THEN 'interact' WHEN c = '' THEN 'no_code' WHEN fn_name IS NOT NULL AND NOT contains(c, 'class Solution') THEN 'no_class' ELSE 'execute' END AS verdict FROM x"""
)
def classify_response(spark, d):
    return scores.classified(responses(spark, d)).select("doc_id", "verdict")


@query("SELECT doc_id, NOT contains(text, ',') AS ok FROM documents")
def ifeval_no_comma(spark, d):
    return _docs(spark, d).select("doc_id", text.has_no_comma("text").alias("ok"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def ifeval_words(spark, d):
    return _docs(spark, d).select("doc_id", text.word_count("text").alias("n"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) AS INTEGER) AS n FROM documents")
def ifeval_sentences(spark, d):
    return _docs(spark, d).select("doc_id", text.sentence_count("text").alias("n"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS INTEGER) AS n FROM documents")
def ifeval_keyword(spark, d):
    return _docs(spark, d).select("doc_id", text.keyword_count("text", "The").alias("n"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_SENTENCES = "len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S')))"


@query(
    f"""WITH s AS (SELECT doc_id, CASE WHEN contains(text, ',') THEN 0.0 ELSE 1.0 END AS comma, {_WORDS} AS words, {_SENTENCES} AS sentences, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS seen FROM documents)
    SELECT doc_id, round((comma + 0.5 + CASE doc_id % 4
        WHEN 0 THEN CASE WHEN words >= 100 THEN 1.0 ELSE 0.0 END + CASE WHEN sentences >= 3 THEN 1.0 ELSE 0.0 END + 1.0
        WHEN 1 THEN CASE WHEN words < 60 THEN 1.0 ELSE 0.0 END + CASE WHEN sentences <= 5 THEN 1.0 ELSE 0.0 END + CASE WHEN seen >= 2 THEN 1.0 ELSE 0.0 END
        WHEN 2 THEN 0.0 + 0.5 + 0.5 ELSE 0.5 + 0.5 + 0.5 END) / 6, 8) AS reward FROM s"""
)
def ifeval_reward(spark, d):
    """Settings absent, given, null or of an unknown relation, by row; one name more
    than there are settings."""
    names = F.array(*[F.lit(x) for x in ("punctuation:no_comma", "unknown:one", "length_constraints:number_words", "length_constraints:number_sentences", "keywords:frequency", "punctuation:no_comma")])
    json = {
        0: "[{}, {}, {}, {}, {}]",
        1: '[{}, {}, {"relation": "less than", "num_words": "60"}, {"relation": "at most", "num_sentences": "5"}, {"keyword": "The", "frequency": "2"}]',
        2: '[{}, {}, {"relation": "around", "num_words": null}, {"num_sentences": null}, {"keyword": null}]',
        3: "[null, null, null, null, null]",
    }
    given = F.lit(json[3])
    for k in (0, 1, 2):
        given = F.when(F.col("doc_id") % 4 == k, json[k]).otherwise(given)
    return _docs(spark, d).select("doc_id", rounded(text.instruction_reward("text", names, F.from_json(given, "array<map<string,string>>")), 8).alias("reward"))


_OTHER = "CASE doc_id % 6 WHEN 0 THEN text || ' ' WHEN 1 THEN replace(text, chr(10), ' ' || chr(10) || ' ') WHEN 2 THEN replace(text, ' ', '  ') WHEN 3 THEN replace(text, chr(10), chr(10) || chr(10) || '  ' || chr(10)) WHEN 4 THEN replace(text, ' ', chr(10)) ELSE text || 'x' END"
_NONBLANK = "list_filter(list_transform(regexp_split_to_array({0}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {1}), lambda x: x <> '')"


@query(
    f"""WITH p AS (SELECT doc_id, text AS a, {_OTHER} AS b FROM documents),
    l AS (SELECT doc_id, a, b, {_NONBLANK.format('a', _STRIP.format('x'))} AS la, {_NONBLANK.format('b', _STRIP.format('x'))} AS lb FROM p)
    SELECT doc_id, CASE WHEN {_STRIP.format('a')} = {_STRIP.format('b')} THEN 'trimmed' WHEN la = lb THEN 'lines'
    WHEN list_transform(la, lambda x: regexp_split_to_array(x, '\\s+')) = list_transform(lb, lambda x: regexp_split_to_array(x, '\\s+')) THEN 'tokens' END AS tier FROM l"""
)
def compare_tiers(spark, d):
    """Blank lines don't count; tokens that move to another line do."""
    other = F.expr("CASE doc_id % 6 WHEN 0 THEN concat(text, ' ') WHEN 1 THEN replace(text, '\\n', ' \\n ') WHEN 2 THEN replace(text, ' ', '  ') WHEN 3 THEN replace(text, '\\n', '\\n\\n  \\n') WHEN 4 THEN replace(text, ' ', '\\n') ELSE concat(text, 'x') END")
    return _docs(spark, d).select("doc_id", text.match_tier(F.col("text"), other).alias("tier"))


def _loose(x: str) -> str:
    return f"replace(replace(lower({_STRIP.format(x)}), ' ', ''), chr(92) || ',', '')"


@query(f"SELECT doc_id, contains({_loose('text')}, {_loose('substr(text, 5, 30)')}) AS ok, contains({_loose('text')}, 'thequick') AS odd FROM documents")
def normalise_contains(spark, d):
    return _docs(spark, d).select("doc_id", text.loosely_contains("text", F.substring("text", 5, 30)).alias("ok"), text.loosely_contains("text", F.lit("the Quick")).alias("odd"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, ' ')) > 20 THEN 'Output too long, showing only last 20 tokens.' || chr(10) || array_to_string(string_split(text, ' ')[-20:], ' ') ELSE text END AS shown FROM documents")
def tail_truncate(spark, d):
    return _docs(spark, d).select("doc_id", text.tail_tokens("text", 20).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shown FROM documents")
def viewer_preview(spark, d):
    return _docs(spark, d).select("doc_id", text.preview("text").alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '<interact>x</interact>' WHEN doc_id % 3 = 1 THEN text || '<interact>x</interact>' ELSE text END AS closed FROM documents")
def close_interact(spark, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("<interact>x"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("<interact>x</interact>"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", text.close_interact(made).alias("closed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parsed_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", nested.parsed("props", "k long")["k"].alias("k"))


@query("SELECT event_id, CAST(event_id * 10 AS BIGINT) AS low, CAST(event_id * 10 + 9 AS BIGINT) AS high FROM events")
def ranges_from_names(spark, d):
    name = F.concat_ws("_", F.lit("set"), (F.col("event_id") * 10).cast("string"), (F.col("event_id") * 10 + 9).cast("string"))
    low, high = text.id_range(name)
    return table(spark, d, "events").select("event_id", low.alias("low"), high.alias("high"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    f"""{M} SELECT conv_id, CASE WHEN len(messages) = 2 THEN concat({_quoted(turns.REFINE_HEAD)}, {_STRIP.format('messages[1].content')}, {_quoted(turns.REFINE_MIDDLE)}, {_STRIP.format('messages[2].content')}, {_quoted(turns.REFINE_TAIL)})
    ELSE concat({_quoted(turns.COMBINE_HEAD)}, {_STRIP.format('messages[1].content')}, {_quoted(turns.COMBINE_MIDDLE)}, array_to_string(list_transform(messages[2:], lambda x, i: concat('---- Solution ', i, ' ----', chr(10), {_STRIP.format('x.content')})), chr(10)), {_quoted(turns.COMBINE_TAIL)}) END AS prompt
    FROM m WHERE len(messages) >= 2"""
)
def aggregation_prompt(spark, d):
    m = messages(spark, d).where(F.size("messages") >= 2)
    rest = F.transform(F.expr("slice(messages, 2, size(messages))"), lambda x: x["content"])
    return m.select("conv_id", turns.aggregation_prompt(F.get("messages", F.lit(0))["content"], rest).alias("prompt"))


@query(
    f"""{R}, x AS (SELECT doc_id, fn_name, doc_id % 4 < 2 AS has, 1 + doc_id % 3 AS turn, contains(response, '<interact>print') OR contains(response, '<interact>' || repeat(chr(96), 3)) AS runs,
        coalesce({_STRIP.format(f'({_FENCES})[-1]')}, '') AS c FROM r),
    k AS (SELECT *, CASE WHEN runs THEN 'interact' WHEN c = '' THEN 'invalid' WHEN has THEN 'final' WHEN turn >= 3 THEN 'no_interaction' ELSE 'must_interact' END AS kind FROM x)
    SELECT doc_id, kind, kind = 'final' AS terminated, CASE WHEN kind = 'final' THEN fn_name IS NOT NULL AND NOT contains(c, 'class Solution') ELSE turn >= 3 END AS truncated,
    CASE kind WHEN 'must_interact' THEN {_quoted(environment.MUST_INTERACT)} WHEN 'no_interaction' THEN '' WHEN 'invalid' THEN CASE WHEN has THEN {_quoted(environment.INVALID_LATER)} ELSE {_quoted(environment.INVALID_FIRST)} END END AS observation FROM k"""
)
def env_step(spark, d):
    """The environment's decision on each response, at every turn of three, with and
    without an interaction before."""
    states = responses(spark, d).withColumns({"has_interacted": F.col("doc_id") % 4 < 2, "current_turn": (F.col("doc_id") % 3).cast("int"), "max_turns": F.lit(3)})
    return environment.acted(states, "response").select("doc_id", "kind", "terminated", "truncated", "observation")


@query("SELECT conv_id, 'NOTE: ' || 'x' AS note FROM conversations WHERE FALSE")
def no_reminder_rows(spark, d):
    """Every first observation ends in the reminder."""
    m = messages(spark, d).select("conv_id", environment.first_observation(F.get("messages", F.lit(0))["content"]).alias("note"))
    return m.where(~F.col("note").endswith(environment.REMINDER))


@query(
    f"""{M}, c AS (SELECT conv_id, list_transform(messages, lambda x: CASE x.role WHEN 'assistant' THEN 'analysis' WHEN 'system' THEN 'commentary' ELSE 'final' END) AS names, list_transform(messages, lambda x: CASE WHEN x.role = 'user' AND conv_id % 3 = 0 THEN '' ELSE x.content END) AS texts FROM m),
    l AS (SELECT conv_id, nullif(list_filter(texts, lambda t, i: names[i] = 'final')[-1], '') AS f, nullif(list_filter(texts, lambda t, i: names[i] = 'commentary')[-1], '') AS k, nullif(list_filter(texts, lambda t, i: names[i] = 'analysis')[-1], '') AS a FROM c)
    SELECT conv_id, coalesce(f, k, a, 'raw') AS content, CASE WHEN f IS NOT NULL THEN 'final' WHEN k IS NOT NULL THEN 'commentary' WHEN a IS NOT NULL THEN 'analysis' ELSE 'unknown' END AS channel, CASE WHEN coalesce(f, k) IS NOT NULL THEN a END AS analysis FROM l"""
)
def channel_resolution(spark, d):
    named = F.transform("messages", lambda x: F.struct(F.when(x["role"] == "assistant", "analysis").when(x["role"] == "system", "commentary").alias("channel"), F.when((x["role"] == "user") & (F.col("conv_id") % 3 == 0), "").otherwise(x["content"]).alias("content")))
    return messages(spark, d).select("conv_id", text.resolved_channel(named, F.lit("raw")).alias("r")).select("conv_id", "r.*")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 0 THEN 'not ' || props END AS raw FROM events")
def parsed_or_raw(spark, d):
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not "), "props")).otherwise(F.col("props")))
    return e.select("event_id", nested.parsed_or_raw("t", "k long").alias("r")).select("event_id", F.col("r.value.k").alias("k"), "r.raw")


@query(f"{M} SELECT conv_id, CAST(len(messages) AS INTEGER) AS n, messages[1].content AS first FROM m")
def serialised_round_trip(spark, d):
    """Messages as JSON text, as tables at rest have them, and back."""
    from tessera.schemas import normalised

    back = normalised(nested.serialised(messages(spark, d), "messages"))
    return back.select("conv_id", F.size("messages").alias("n"), F.get("messages", F.lit(0))["content"].alias("first"))


@query("SELECT doc_id, contains(lower(source || '-GPT-OSS-' || lang), 'gpt-oss') AS family, 'Solve this problem step-by-step: ' || source || chr(10) || chr(10) || ' Put the final answer within ' || chr(92) || 'boxed{}' || chr(10) AS prompt FROM documents")
def plain_prompts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.of_family(F.concat_ws("-", "source", F.lit("GPT-OSS"), "lang")).alias("family"), text.plain_prompt("source").alias("prompt"))


_TAIL = "CASE WHEN length({0}) > {1} THEN concat('Output too long, showing only last {1} tokens.', chr(10), right({0}, {1})) ELSE {0} END"


@query(f"""SELECT doc_id, {_TAIL.format('text', 200)} AS tail, concat('<output>', chr(10), {_TAIL.format('text', 300)}, '</output>', CASE WHEN length(text) <= 300 THEN chr(10) ELSE '' END) AS framed,
    concat(text, ' x') AS unframed, CAST(length(text) AS BIGINT) AS n_tokens FROM documents""")
def token_tail(spark, d):
    """Tails by ids of a vocabulary, here of characters, alone and in frames."""
    t = F.col("text")
    framed = F.concat(F.lit("<output>\n"), t, F.lit("</output>\n"))
    return _docs(spark, d).select(
        "doc_id", tokens.tail_by_ids(t, 200).alias("tail"), tokens.tail_in_frame_by_ids(framed, 300).alias("framed"),
        tokens.tail_in_frame_by_ids(F.concat(t, F.lit(" x")), 5).alias("unframed"), tokens.token_count(t).alias("n_tokens"),
    )


@query(
    f"""{M}, p AS (SELECT conv_id, (SELECT string_agg(concat('<|', x.role, '|>', chr(10), x.content, '<|end|>', chr(10)), '') FROM (SELECT unnest(messages) AS x)) AS said, messages[-1].content AS seen, len(messages) AS n FROM m)
    SELECT conv_id, concat(said, '<|user|>', chr(10), CASE WHEN n % 3 = 0 THEN concat(seen, chr(10), chr(10), 'Answer now.') WHEN n % 3 = 1 THEN 'Answer now.' ELSE seen END, '<|end|>', chr(10), '<|assistant|>', chr(10)) AS prompt,
    CAST(length(said) + 31 + CASE WHEN n % 3 = 0 THEN length(seen) + 13 WHEN n % 3 = 1 THEN 11 ELSE length(seen) END AS BIGINT) AS n_tokens FROM p"""
)
def chat_prompts(spark, d):
    """Conversations as prompts: what was seen last is said again, on the last turn
    (here if the messages' number divides by three or leaves one) with the final
    prompt, which stands alone after an empty observation."""
    m = messages(spark, d)
    n = F.size("messages") % 3
    seen = F.when(n != 1, F.try_element_at("messages", F.lit(-1))["content"]).otherwise("")
    last = F.when(n < 2, 4).otherwise(0)
    prompt = tokens.rendered_chat(tokens.turn_messages("messages", seen, last, F.lit(5), "Answer now."))
    return m.select("conv_id", prompt.alias("prompt")).withColumn("n_tokens", tokens.token_count("prompt"))


@query(
    """SELECT doc_id, 'plain' AS kind, 0 AS pos, 'system' AS role, 'Be brief.' AS content FROM documents UNION ALL SELECT doc_id, 'plain', 1, 'user', text FROM documents
    UNION ALL SELECT doc_id, 'noted', 0, 'system', '[Harmony format] Reasoning effort: high' FROM documents UNION ALL SELECT doc_id, 'noted', 1, 'developer', 'Use tools.' FROM documents UNION ALL SELECT doc_id, 'noted', 2, 'user', text FROM documents"""
)
def opening_chat(spark, d):
    """The first messages of a record, with a system row, and with developer rows."""
    kinds = {"plain": tokens.opening_messages("text", "Be brief."), "noted": tokens.opening_messages("text", "", "Use tools.", "high")}
    rows = [_docs(spark, d).select("doc_id", F.lit(k).alias("kind"), F.posexplode(m).alias("pos", "m")) for k, m in kinds.items()]
    return rows[0].union(rows[1]).select("doc_id", "kind", "pos", "m.role", "m.content")


_SAID = "(SELECT conv_id, turn, role, text AS t, (conv_id + turn) % 10 AS k FROM conversations)"


@query(
    f"""SELECT conv_id, turn, k IN (6, 5, 0) AS parse_error, CASE WHEN k IN (6, 5, 0) THEN 0 WHEN k IN (1, 2, 7) THEN 2 WHEN k = 3 THEN 3 ELSE 1 END AS n_messages,
    CASE k WHEN 0 THEN t WHEN 5 THEN concat('<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>fin') WHEN 6 THEN concat('<|channel|>final<|message|>', t, '<|end|> and more')
        WHEN 3 THEN concat(t, ' again') WHEN 4 THEN t WHEN 8 THEN t WHEN 9 THEN concat('f(', t, ')') ELSE t END AS content,
    CASE k WHEN 0 THEN 'parse_error' WHEN 5 THEN 'parse_error' WHEN 6 THEN 'parse_error' WHEN 4 THEN 'analysis' WHEN 9 THEN 'commentary' ELSE 'final' END AS channel,
    CASE WHEN k IN (1, 2, 7) THEN 'thinking' WHEN k = 3 THEN 'first' END AS analysis, CASE WHEN k = 9 THEN 'functions.f' END AS recipient FROM {_SAID}"""
)
def channel_markup(spark, d):
    """Marked-up answers read: plain, thoughts before an answer, without an end or a
    start, a repeated channel, broken and cut headers, text after the end, a call."""
    t, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 10
    opened, thought = F.lit("<|channel|>final<|message|>"), F.lit("<|channel|>analysis<|message|>thinking")
    forms = [
        t,
        F.concat(thought, F.lit("<|end|><|start|>assistant"), opened, t, F.lit("<|return|>")),
        F.concat(thought, F.lit("<|end|>"), opened, t),  # the start is missing
        F.concat(F.lit("<|channel|>analysis<|message|>first<|end|><|start|>assistant"), opened, t, F.lit("<|end|><|start|>assistant"), opened, t, F.lit(" again<|return|>")),
        F.concat(F.lit("<|channel|>analysis<|message|>"), t),  # cut within the thought
        F.lit("<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>fin"),  # cut within a header
        F.concat(opened, t, F.lit("<|end|> and more")),
        F.concat(F.lit("<|start|>assistant"), thought, opened, t, F.lit("<|end|>\n")),  # the thought's end and a start are missing
        F.concat(F.lit("<|start|>robot<|message|>"), t, F.lit("<|end|>")),  # neither role nor channel
        F.concat(F.lit("<|start|>assistant to=functions.f<|channel|>commentary <|constrain|>json<|message|>f("), t, F.lit(")<|call|>")),
    ]
    marked = F.get(F.array(*forms), k)
    rows = table(spark, d, "conversations").select("conv_id", "turn", marked.alias("marked"))
    read = rows.select("conv_id", "turn", "marked", channels.parsed_markup("marked").alias("r"))
    return read.select("conv_id", "turn", "r", channels.answer_of("r", "marked").alias("a")).select("conv_id", "turn", "r.parse_error", F.size("r.messages").alias("n_messages"), "a.content", "a.channel", "a.analysis", F.get("r.messages", F.lit(0))["recipient"].alias("recipient"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, l_linenumber AS b, l_partkey % 3 AS off, l_suppkey % 5 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE k WHEN 4 THEN off = 0 ELSE a * (2 * b + off) = b * 2 * a END AS agrees,
    CASE k WHEN 0 THEN concat(chr(92), 'frac{', a, '}{', b, '}') WHEN 1 THEN concat(a, '/', b) WHEN 2 THEN concat(chr(92), 'frac{', 100 * a, '}{', b, '}', chr(92), '%') WHEN 3 THEN concat('-', chr(92), 'frac{', -a, '}{', b, '}') ELSE concat(chr(92), 'sqrt{', a * a * 3, '}') END AS boxed FROM a"""
)
def symbolic_answers(spark, d):
    """Boxed fractions, quotients, percentages, signs and roots against fractions
    and roots that are equal or off."""
    a, b, k = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_suppkey") % 5
    off = F.col("l_partkey") % 3
    frac = lambda x, y: F.concat(F.lit("\\frac{"), x.cast("string"), F.lit("}{"), y.cast("string"), F.lit("}"))
    form = (
        F.when(k == 0, frac(a, b)).when(k == 1, F.concat_ws("/", a, b)).when(k == 2, F.concat(frac(100 * a, b), F.lit("\\%")))
        .when(k == 3, F.concat(F.lit("-"), frac(-a, b))).otherwise(F.concat(F.lit("\\sqrt{"), (a * a * 3).cast("string"), F.lit("}")))
    )
    target = F.when(k == 4, F.concat((a + off).cast("string"), F.lit("\\sqrt{3}"))).otherwise(frac(2 * a, 2 * b + off))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("I take \\boxed{1}, no: \\boxed{"), form, F.lit("}.")).alias("response"), target.alias("target"))
    return rows.select("l_orderkey", "l_linenumber", answers.answer_agrees("response", "target").alias("agrees"), answers.boxed("response").alias("boxed"))
