"""The opN_ queries: each applies its operator, with production parameters, to
the whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import dac, langid, lines, minhash, packing, pieces, pii, quality, runs, sharding, suffixes, wand, winnow
from tessera.llm.common import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(_documents(spark, sf_dir), with_text=False)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_documents(spark, sf_dir))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_output(_documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(_documents(spark, sf_dir))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(_documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    # rounded past the last bits, in which sums in another order differ
    rate = F.round(F.col("host_rate") + 1e-11, 8).alias("host_rate")
    return quality.judge(_documents(spark, sf_dir).select("doc_id", "source", "text")).select(*columns, rate)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as its newest manifest has it, and whether each row's shard keeps
    to the target size."""
    table = sharding.compacted(_documents(spark, sf_dir), shared_path(spark, "shards"))
    return table.read().select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"),
        (F.col("_metadata.file_size") <= 3 * table.target // 2).alias("shard_in_bounds"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def planted_repeats(doc_ids: list, first: np.ndarray) -> np.ndarray:
    """The word at each place, once a tenth of the documents (by the crc32 of their
    id) repeat words up to their ends. Rows without an id repeat none."""
    place = np.arange(first[-1])
    for doc, a, b in zip(doc_ids, first[:-1].tolist(), first[1:].tolist()):
        h, n = zlib.crc32(str(doc).encode()), b - a
        if doc is not None and n and h % 10 == 0:
            g = h // 10
            begin = g % n
            period = 1 + (n - begin) // (3 + g % 8)
            place[a + begin : b] = a + begin + np.arange(n - begin) % period
    return place


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_documents(spark, sf_dir), planted_repeats)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.concat_ws("\n", F.transform("runs", line)), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_codes": op3_token_codes,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_language_id": op6_language_id,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

#: DuckDB SQL of the queries that SQL expresses; the others are tested against
#: brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN n_symbols > CAST(0.1 AS DOUBLE) * word_chars THEN 1 ELSE 0 END + CASE WHEN n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines THEN 1 ELSE 0 END AS strikes FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed OR strikes > 0) AS DOUBLE) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(x) / sum(n) AS mean, (sum(x * x / n) - sum(n) * (sum(x) / sum(n)) ** 2 - (count(*) - 1) * (sum(x) / sum(n)) * (1 - sum(x) / sum(n))) / nullif(sum(n) - sum(n * n) / sum(n), 0) AS between_hosts FROM h),
q AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e9) ELSE 1e9 END AS weight FROM p),
s AS (SELECT source, (x + mean * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate + 1e-11, 8) AS host_rate,
    NOT base_failed AND strikes <= CASE WHEN coalesce(rate > 0.5, FALSE) THEN 0 ELSE 1 END AS kept FROM f LEFT JOIN s USING (source)""",
    "op10_sharding": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, TRUE AS shard_in_bounds FROM documents",
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(w) AS t, CAST(len(w) AS BIGINT) AS n FROM d) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // CAST(n_terms AS BIGINT))))) AS BIGINT) AS score
    FROM q JOIN f USING (t) JOIN p USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    "op13_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY doc_id""",
}
