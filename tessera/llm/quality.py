"""Quality rules of documents and their hosts.

Each whole text is measured and judged by rules; failures are summed by host
(the source of a document), each host's failure rate is shrunk towards all
hosts' by a beta prior that is fitted to them, and the verdict on the host is
joined back: documents of a host with a high rate are held to the strict rules,
of which others may break one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import content_hashes, cut, fresh, steps
from tessera.llm.words import within, windows, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Base rule: fewest words; strict rules: shares of symbols and of repeated lines.
MIN_WORDS, SYMBOL_SHARE, DUP_LINE_SHARE = 10, 0.1, 0.3
#: A host with a higher shrunken failure rate is distrusted.
HOST_RATE = 0.5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags in each [bounds[i], bounds[i+1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text (no nulls)."""
    w = words_of(texts)
    data, offsets, n = w.data, w.offsets, len(texts)
    out = {"n_words": np.diff(w.doc_start)}
    out["word_chars"] = _sums(((data & 0xC0) != 0x80) & ~w.space, offsets)
    out["n_symbols"] = _sums(_IS_SYMBOL[data], offsets)
    # lines: spans between line feeds and the ends of texts
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([offsets[1:] - 1, feeds]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    has = np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, ends)
    starts, ends, doc = starts[has], ends[has], doc[has]
    keys = within(content_hashes(data, starts, ends), doc)
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[first], minlength=n)
    # words in windows that are found twice or more
    covered = np.zeros(len(w.starts) + 1, np.int64)
    hashes, at = windows(w.hashes(), w.doc_start, WINDOW)
    if len(at):
        keys = within(hashes, np.searchsorted(w.doc_start, at, side="right"))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered[:-1]) > 0, w.doc_start)
    return out


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of *docs* but the text, and the measures. Null text has none
    of anything."""
    keep = [c for c in docs.columns if c != text_col and c not in MEASURES]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    (text,) = fresh(docs, "__text")
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                found = measure(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(found[m].astype(np.int64)) for m in MEASURES], [*keep, *MEASURES])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text)).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def strikes():
    """How many strict rules a document breaks."""
    return (F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars")).cast("int") + (F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines")).cast("int")


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, host_docs, host_failures, host_rate) with shrunken rates.

    The prior's mean and weight come from the hosts' rates by moments: the
    spread beyond what sampling alone would give sets how little hosts are
    shrunk. Without any such spread, a host has the common rate."""
    failed = (base_failed() | (strikes() > 0)).cast("long")
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(failed).alias("host_failures"))
    n, x = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    m = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.count("*").alias("k"), F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("rx")).first()
    weight, mean = 0.0, 0.0
    if m["n"]:
        mean = m["x"] / m["n"]
        spread = m["rx"] - m["n"] * mean * mean  # weighted square deviations of the rates
        expected = (m["k"] - 1) * mean * (1 - mean)
        size = m["n"] - m["nn"] / m["n"]
        between = (spread - expected) / size if size > 0 else 0.0
        weight = mean * (1 - mean) / between - 1 if between > 0 else 1e9
        weight = min(max(weight, 1.0), 1e9)
    return hosts.withColumn("host_rate", (x + F.lit(mean * weight)) / (n + F.lit(weight)))


def judge(docs: DataFrame, host: str = "source", text_col: str = "text", host_rate: float = HOST_RATE) -> DataFrame:
    """All columns of *docs* but the text, the measures, base_failed, strikes,
    host_rate and kept.

    Columns of the input with these names are replaced. A null host is no host:
    its documents are judged alone. Repeated rows are judged each; an empty
    table gives an empty one. A document that passes every rule is kept,
    whatever its host."""
    made = ("base_failed", "strikes", "host_rate", "host_docs", "host_failures", "kept")
    measured = cut(with_measures(docs.drop(*[c for c in made if c in docs.columns]), text_col), "measures")
    # written, so that the join is planned on the size that hosts have: broadcast if
    # they are few, else by sorting, where the parts of a large host are split
    hosts = cut(host_rates(measured, host).select(host, "host_rate"), "hosts")
    joined = measured.join(hosts, host, "left")
    distrusted = F.coalesce(F.col("host_rate") > host_rate, F.lit(False))
    keep = [c for c in measured.columns]
    return joined.select(
        *[F.col(f"`{c}`") for c in keep],
        base_failed().alias("base_failed"),
        strikes().alias("strikes"),
        "host_rate",
        (~base_failed() & (strikes() <= F.when(distrusted, 0).otherwise(1))).alias("kept"),
    )
