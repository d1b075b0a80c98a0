"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit, hashed byte n-grams are
weighed for the languages whose bit is set against the others (binary naive
Bayes on the languages' n-gram shares, so that a large language doesn't crowd out
the rest).  A text's margin for a bit is the mean weight of its n-grams times a
function of their number; the language whose codeword has the least loss,
weighted by how well each bit separates, is chosen.  A text whose bits are as
near to another codeword, or beyond correction, is flagged as ambiguous."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, forget, fresh, steps, written

ORDERS = (2, 3, 4)
#: Hash buckets of each order.
BUCKETS = 1 << 15
#: Documents of each language that are learned from, about: rows are drawn by a
#: hash at the rate that gives so many.
SAMPLE = 3000
BITS = 31
#: Languages up to which the best of many random codes is sought.
SOUGHT = 64
UNKNOWN = "und"
#: Difference of normalised loss below which a choice is ambiguous.
CLOSE = 0.02

_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of all texts, offsets of each text): lower-cased
    bytes between spaces; an n-gram lies in one text and its closing spaces."""
    texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_lower(texts.cast(pa.large_string())), pa.scalar("    ", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, offsets = bytes_of(texts)
    n = len(data) - 4
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    wide = data.astype(np.uint32)
    out = np.empty((n, len(ORDERS)), np.int32)
    h = wide[:n] * _FACTORS[0]
    k = 0
    for j in range(1, max(ORDERS)):
        h = h + wide[j : n + j] * _FACTORS[j]
        if j + 1 in ORDERS:
            x = h * np.uint32(0x2C1B3C6D)
            out[:, k] = (x >> np.uint32(17)) + BUCKETS * k
            k += 1
    starts, ends = offsets[:-1], np.minimum(offsets[1:] - 5, n)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts[starts < n], 1)
    np.add.at(inside, ends, -1)
    keep = np.cumsum(inside[:n]) > 0
    counts = np.concatenate([[0], np.cumsum(np.maximum(ends - starts, 0))])
    return out[keep].ravel(), counts * len(ORDERS)


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """A row of -1 and 1 for each of n languages. Up to five: every way to part
    them, once. More: seeded random codes, of few languages the best by least
    distance; their bits grow with the logarithm of the languages."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [[1] + [1 if m >> i & 1 else -1 for i in range(n - 1)] for m in range((1 << (n - 1)) - 1)]
        return np.array(cols, np.int8).T
    rng, best, found = np.random.default_rng(7), -1, None
    bits = max(bits, int(np.ceil(4 * np.log2(n))))
    for _ in range(50 if n <= SOUGHT else 1):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0, dtype=np.int64)) < n]
        least = distance(code)
        if least > best:
            best, found = least, code
    return found


def distance(code: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    wide, least = code.astype(np.float32), code.shape[1]
    for a in range(0, len(code), 512):
        agree = wide[a : a + 512] @ wide.T
        agree[np.arange(len(agree)), np.arange(a, a + len(agree))] = -code.shape[1]
        least = min(least, int((code.shape[1] - agree.max()) / 2))
    return least


class Model:
    """Languages, their codewords, weights of n-grams for each bit (buckets x bits)
    and the bits' loss weights."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, loss_weight: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights
        total = loss_weight.sum()
        self.loss_weight = loss_weight / total if total else loss_weight
        self.distance = distance(code) if len(languages) > 1 else 0

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text; no nulls."""
        n = len(texts)
        letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        g, ends = grams(texts)
        sizes = np.diff(ends)
        margin = np.zeros((n, self.code.shape[1]))
        some = np.flatnonzero(sizes)
        for i in some:  # in parts that fit a processor's cache
            a, b = ends[i], ends[i + 1]
            for j in range(a, b, 1 << 16):
                margin[i] += self.weights[g[j : min(j + (1 << 16), b)]].sum(0)
        count = np.maximum(sizes, 1)[:, None] / len(ORDERS)
        margin *= 4 / np.sqrt(count) / len(ORDERS)
        # of each bit, the loss if it is unset, and how much more if it is set
        unset = self.loss_weight * np.logaddexp(0, margin)
        loss = unset.sum(1, keepdims=True) + (self.loss_weight * np.logaddexp(0, -margin) - unset) @ (self.code > 0).T
        best = loss.argmin(1)
        scores = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = 1 / scores.sum(1)
        ambiguous = np.zeros(n, bool)
        if len(self.languages) > 1:
            two = np.partition(loss, 1, axis=1)[:, :2]
            apart = (margin > 0) != (self.code[best] > 0)
            radius = (self.distance - 1) // 2
            ambiguous = (two[:, 1] - two[:, 0] < CLOSE * np.maximum(two[:, 1], 1e-9)) | (apart.sum(1) > radius)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, score, 0.0), ambiguous | ~letters


def _order(bucket):
    """Which n-gram order a bucket belongs to, from 0."""
    return F.floor(F.col(bucket) / BUCKETS).cast("int")


def gram_counts(drawn: DataFrame) -> DataFrame:
    """(language, bucket, n) of rows of language and text, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS * len(ORDERS)
        for batch in batches:
            for part in steps(batch):
                g, ends = grams(part.column("text"))
                language = np.repeat(part.column("language").to_numpy(), np.diff(ends)).astype(np.int64)
                keys, n = np.unique(language * width + g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(n)], ["language", "bucket", "n"])

    return drawn.mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits to (doc_id, text, lang) rows; null texts and languages are left out.

    All labels are learned. Counts by language and bucket stay in tables; joined with
    the codewords they are added up to shares by bucket and bit, which reach the
    driver (buckets x bits), as do each language's name and size: what grows with
    the labels there is a name and a codeword each."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    code = codewords(len(languages))
    bits, width = code.shape[1], BUCKETS * len(ORDERS)
    if not languages:
        return Model([], code, np.zeros((width, bits), np.float32), np.zeros(bits))
    known = pa.table({"lang": pa.array(languages), "language": pa.array(range(len(languages)), pa.int32()), "rate": pa.array([min(1.0, sample / sizes[k]) for k in languages]), "code": pa.array(code.tolist(), pa.list_(pa.int8()))})
    # written, so that Spark broadcasts it if it is small
    table, path = written(spark.createDataFrame(known), "languages")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(table.select("lang", "language", "rate"), "lang").where(draw < F.col("rate")).select("language", "text")
    counts, counted = written(gram_counts(drawn), "gram_counts")
    if len(languages) < 2:
        return Model(languages, code, np.zeros((width, bits), np.float32), np.ones(bits))
    # half an occurrence of every n-gram is added; a language's shares of an order sum to one
    totals = table.select("language", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("order")).join(counts.groupBy("language", _order("bucket").alias("order")).agg(F.sum("n").alias("n")), ["language", "order"], "left")
    totals, summed = written(totals.select("language", "order", (F.coalesce("n", F.lit(0)) + 0.5 * BUCKETS).alias("total")).join(table.select("language", "code"), "language"), "totals")
    signed = lambda x: [F.sum(F.when(F.col("code")[b] > 0, x).otherwise(0.0)).alias(f"p{b}") for b in range(bits)]
    base = totals.groupBy("order").agg(F.sum(0.5 / F.col("total")).alias("all"), *signed(0.5 / F.col("total"))).toArrow()
    share = F.col("n") / F.col("total")
    shares = counts.withColumn("order", _order("bucket")).join(totals, ["language", "order"]).groupBy("bucket").agg(F.sum(share).alias("all"), *signed(share)).toArrow()
    total, positive = np.zeros(width), np.zeros((width, bits))
    at = shares["bucket"].to_numpy()
    total[at] = shares["all"].to_numpy()
    positive[at] = np.stack([shares[f"p{b}"].to_numpy() for b in range(bits)], 1)
    for i, k in enumerate(base["order"].to_pylist()):
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        total[own] += base["all"][i].as_py()
        positive[own] += [base[f"p{b}"][i].as_py() for b in range(bits)]
    n_set = (code > 0).sum(0)
    weights = (np.log(positive / n_set) - np.log((total[:, None] - positive) / (len(languages) - n_set))).astype(np.float32)
    loss_weight = _separation(counts, totals, weights)
    for done in (path, counted, summed):
        forget(done)
    return Model(languages, code, weights, loss_weight)


def _separation(counts: DataFrame, totals: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Of each bit, the least mean weight that a language's own n-grams have towards
    its side. Means are added up by language in tables; a row of minima is told."""
    bits = weights.shape[1]
    shared = counts.sparkSession.sparkContext.broadcast(weights)  # buckets x bits
    names = [f"w{b}" for b in range(bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, order = (batch.column(c).to_numpy() for c in ("language", "order"))
            values = shared.value[batch.column("bucket").to_numpy()] * (batch.column("n").to_numpy() / batch.column("total").to_numpy())[:, None]
            keys, which = np.unique(language.astype(np.int64), return_inverse=True)
            sums = np.zeros((len(keys), bits))
            np.add.at(sums, which, values)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *[pa.array(sums[:, b]) for b in range(bits)]], ["language", *names])

    found = counts.withColumn("order", _order("bucket")).join(totals.select("language", "order", "total"), ["language", "order"])
    seen = found.select("language", "order", "bucket", "n", "total").mapInArrow(run, "language int, " + ", ".join(f"{x} double" for x in names))
    flat = weights.reshape(len(ORDERS), BUCKETS, bits).sum(1, dtype=np.float64)
    added = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in flat])
    half = totals.select("language", "code", *[((0.5 / F.col("total")) * added[F.col("order")][b]).alias(x) for b, x in enumerate(names)])
    halves = half.groupBy("language").agg(F.first("code").alias("code"), *[F.sum(x).alias(x) for x in names])
    both = seen.groupBy("language").agg(*[F.sum(x).alias(x) for x in names]).select("language", *[F.col(x).alias(f"s{x}") for x in names]).join(halves, "language", "right")
    least = both.agg(*[F.min((F.coalesce(f"s{x}", F.lit(0.0)) + F.col(x)) / len(ORDERS) * F.col("code")[b]).alias(x) for b, x in enumerate(names)]).first()
    return np.maximum(np.array([least[x] for x in names], np.float64), 1e-3)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of *docs* but the text, and lang_pred, score, ambiguous
    (columns with these names are replaced). A text that is null or has no letter
    is ``und`` with score 0. Only the text decides; an empty table gives an
    empty one."""
    made = ("lang_pred", "score", "ambiguous")
    keep = [c for c in docs.columns if c != text_col and c not in made]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits, and a name and codeword a language
    (text,) = fresh(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                names, score, ambiguous = shared.value.predict(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)], [*keep, *made])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text)).mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def predicted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    flag = F.coalesce(held_out(), F.lit(False))
    model = learn(docs.where(~flag).select("doc_id", "text", "lang"), sample)
    return identify(docs.select("doc_id", flag.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
