"""From raw documents to packed sequences, a decision a stage.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but
the last return the columns of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, packing, pii, quality, suffixes
from tessera.llm.common import cut, fresh


def _row_key() -> tuple:
    """128 bits that name a row's doc_id, source and text."""
    return F.xxhash64("doc_id", "source", "text"), F.xxhash64("text", F.lit(1), "source", "doc_id")


def _over_text(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """*docs* with the text that *change* makes of (row, text), and n_chars that
    says how long it is. A row's other columns travel in one, so that none can
    clash with what *change* makes."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    out = change(whole)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    a, b = fresh(docs, "key", "more")
    key, more = _row_key()
    verdicts = quality.judge(docs.select(key.alias(a), more.alias(b), "source", "text"))
    gone = cut(verdicts.where("not kept").select(a, b).distinct(), "gone")
    return docs.withColumns({a: key, b: more}).join(gone, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    gone = cut(minhash.near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start earlier in the corpus are cut out; a document
    of nothing else keeps its row with an empty text. A character that loses a
    byte goes."""
    light, removed = suffixes.without_repeats(docs.select("doc_id", "text"))
    copies = light.where("is_copy").where(F.col("n_bytes") >= suffixes.LENGTH).select("doc_id", "tkey", F.lit("").alias("kept_text")).distinct()
    new = removed.select("doc_id", "tkey", "kept_text").union(copies)

    def shortened(rows: DataFrame) -> DataFrame:
        keyed = rows.select("row", "text", F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"))
        return keyed.join(new, ["doc_id", "tkey"], "left").select("row", F.coalesce("kept_text", "text").alias("text"))

    return _over_text(docs, shortened)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets."""
    return _over_text(docs, lambda rows: pii.mask(pii.detect(rows)))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of at most 2048."""
    return packing.best_fit_pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: SQL expresses neither the host prior's fit, the suffix order nor the tokens;
#: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
