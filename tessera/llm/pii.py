"""Personal data in texts by weak supervision, in DataFrame expressions alone.

Strict patterns find base spans, loose ones further candidates.  Each candidate
is voted on by a pattern, a shape, a gazetteer, a context and a boundary
labeler (for, against, or silent).  The votes of all documents are counted by
kind and vote pattern, of which there is a fixed number; expectation-
maximisation on these counts estimates how reliable each labeler is.  Its
posteriors train a naive Bayes classifier on features of the spans, and
candidates that it accepts join the base spans, which always stay."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import aside, cut

#: Kinds in the order of output; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "id", "name")
BASE = KINDS[:4]

# The base patterns, written so that Java neither recurses nor retries: runs are
# possessive, and a run is only entered at its start or where a match has ended.
#: Stands for a separator between two digits; a private character, one for one.
MARK = "\ue0f0"
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9\ue0f0]{13,}",  # on text whose single separators between digits are marked
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?[\(\[]?\bat\b[\)\]]? ?[A-Za-z0-9-]{2,63} ?[\(\[]?\bdot\b[\)\]]? ?[A-Za-z]{2,6}\b",
    "phone": r"(?<![0-9+.-])(?<!\+[0-9] )\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur)\.? \p{Lu}\p{Ll}{2,20} \p{Lu}\p{Ll}{2,20}\b",
}
#: Cheap conditions without which a text has no match.
_NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike("(?:[0-9][ -]?){12}[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_LOOSE_NEEDS = {
    "email": lambda t: t.rlike(r"[ \(\[]at[ \)\]]") & t.rlike(r"[ \(\[]dot[ \)\]]"),
    "phone": lambda t: t.rlike("[0-9][ .-][0-9]{4}"),
    "id": lambda t: t.rlike("[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
    "name": lambda t: t.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur)\b"),
}
#: Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "example")
DIAL_CODES = ("1", "33", "34", "44", "49")
#: Words around a span that speak for it, and against.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|call|tel|fax|mobile|reach",
    "id": "ssn|social|iban|account|passport",
    "name": "dear|by|contact|from|to|von|de",
}
AGAINST = "version|isbn|order|invoice|figure|part|serial"
LABELERS = ("pattern", "shape", "gazetteer", "context", "boundary")
FEATURES = ("kind", "length", "digits", "left", "right", "near")
BEFORE = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = v * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(worth(i), F.lit(0))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        d = _digits(x)
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x["text"])


def _of(kind: str, base: bool = False):
    return lambda s: s["base"] & (s["kind"] == kind) if base else s["kind"] == kind


def _located(df: DataFrame, name: str, text: Column, pattern: str, needed: Column) -> DataFrame:
    """Adds an array of (start, end, text, before, after) of a pattern's matches,
    in code points. Offsets are running sums over blocks of the square root of
    the number of matches, so that many matches don't cost their square."""
    segs, found, lens, block, sums = (f"__{name}_{x}" for x in ("segs", "found", "lens", "block", "sums"))
    df = df.withColumn(found, F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(segs, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumns({lens: F.zip_with(F.slice(F.col(segs), F.lit(1), F.size(found)), F.col(found), lambda a, b: F.length(a) + F.length(b)), block: F.greatest(F.ceil(F.sqrt(F.size(found))).cast("int"), F.lit(1))})
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    blocks = F.when(F.size(found) > 0, F.sequence(F.lit(0), ((F.size(found) - 1) / F.col(block)).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(sums, F.transform(blocks, lambda b: total(F.slice(F.col(lens), b * F.col(block) + 1, F.col(block)))))
    df = df.withColumn(sums, F.transform(blocks, lambda b: total(F.slice(F.col(sums), F.lit(1), b))))

    def place(x: Column, i: Column) -> Column:
        b = (i / F.col(block)).cast("int")
        start = F.get(F.col(sums), b) + total(F.slice(F.col(lens), b * F.col(block) + 1, i % F.col(block))) + F.length(F.get(F.col(segs), i))
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text"), F.right(F.get(F.col(segs), i), F.lit(BEFORE)).alias("before"), F.left(F.get(F.col(segs), i + 1), F.lit(1)).alias("after"))

    return df.withColumn(name, F.transform(F.col(found), place)).drop(segs, found, lens, block, sums)


def _candidate(kind: str, strict: bool):
    """The candidate of a located match: span, votes and features."""

    def make(x: Column) -> Column:
        text, before, after = x["text"], F.lower(x["before"]), x["after"]
        plain = F.lower(text)
        digits = F.length(_digits(text))
        word = r"(?U)\w$"
        context = F.when(before.rlike(AGAINST), -1).when(before.rlike(rf"\b(?:{CONTEXT[kind]})"), 1).otherwise(0)
        apart = F.when(before.rlike(word) | after.rlike(r"(?U)^\w"), -1).otherwise(1)
        shape, gazetteer = F.lit(0), F.lit(0)
        if kind == "email":
            shape = F.when(plain.rlike("[a-z]{2,6}$"), 1).otherwise(-1)
            gazetteer = F.when(plain.rlike(rf"(?:{'|'.join(DOMAINS)})$"), 1).otherwise(0)
        elif kind == "ip":
            shape = F.when(text.rlike(r"^(?:[0-9]\.){3}[0-9]$"), -1).otherwise(1)
            gazetteer = F.when(text.rlike(r"^(?:10|127|192\.168|172)\."), 1).otherwise(0)
        elif kind == "card":
            shape = F.when(digits.isin(15, 16), 1).otherwise(0)
            gazetteer = F.when(_digits(text).rlike("^[3-6]"), 1).otherwise(-1)
        elif kind == "phone":
            shape = F.when(digits.between(9, 13), 1).otherwise(-1)
            gazetteer = F.when(text.startswith("+") & _digits(text).rlike(rf"^(?:{'|'.join(DIAL_CODES)})"), 1).when(text.startswith("("), 1).otherwise(0)
        elif kind == "id":
            shape = F.when(text.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1)
            gazetteer = F.when(text.rlike("^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE)"), 1).otherwise(0)
        else:
            shape = F.when(F.length(text).between(9, 40), 1).otherwise(-1)
        votes = {"pattern": F.lit(1 if strict else 0), "shape": shape, "gazetteer": gazetteer, "context": context, "boundary": apart}
        char = lambda c: F.when(c == "", "edge").when(c.rlike(r"(?U)\s"), "space").when(c.rlike(r"(?U)\w"), "word").otherwise("mark")
        features = {
            "kind": F.lit(kind),
            "length": F.least(F.floor((x["end"] - x["start"]) / 4), F.lit(12)).cast("string"),
            "digits": F.floor(4 * digits / F.greatest(F.length(text), F.lit(1))).cast("string"),
            "left": char(F.right(before, F.lit(1))),
            "right": char(after),
            "near": context.cast("string"),
        }
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(strict).alias("strict"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.concat_ws(",", *[votes[v].cast("string") for v in LABELERS]).alias("votes"),
            F.array(*[F.concat(F.lit(f"{f}="), features[f]) for f in FEATURES]).alias("features"),
        )

    return make


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of *docs* and ``__cands``: for each text (null: empty) its
    base spans and the loose matches that don't touch one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.withColumn("__t", text)
    unmarked = F.translate(F.col("__t"), MARK, "x")
    df = df.withColumn("__marked", F.when(_NEEDS["card"](F.col("__t")), F.regexp_replace(unmarked, "(?<=[0-9])[ -](?=[0-9])", MARK)).otherwise(F.lit("")))
    names = []
    for kind, pattern in STRICT.items():
        on = F.col("__marked" if kind == "card" else "__t")
        need = F.col("__marked") != "" if kind == "card" else _NEEDS[kind](on)
        df = _located(df, f"__s_{kind}", on, pattern, need)
        df = df.withColumn(f"__s_{kind}", F.transform(F.filter(F.col(f"__s_{kind}"), _checked(kind)), _candidate(kind, True)))
        names.append(f"__s_{kind}")
    df = df.withColumn("__base", F.concat(*names)).drop("__marked", *names)
    loose = []
    for kind, pattern in LOOSE.items():
        df = _located(df, f"__l_{kind}", F.col("__t"), pattern, _LOOSE_NEEDS[kind](F.col("__t")))
        apart = lambda x: ~F.exists(F.col("__base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        df = df.withColumn(f"__l_{kind}", F.transform(F.filter(F.col(f"__l_{kind}"), apart), _candidate(kind, False)))
        loose.append(f"__l_{kind}")
    return df.withColumn("__cands", F.concat("__base", *loose)).drop("__t", "__base", *loose)


def reliabilities(counts: list[tuple[str, str, int]], steps: int = 50) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) by expectation-maximisation on counts: a
    prior for each kind, and for each labeler what it says of true and of false
    candidates. The labelers' majority starts it."""
    votes = {v: [int(x) for x in v.split(",")] for _, v, _ in counts}
    post = {(k, v): min(max(0.5 + sum(votes[v]) / (2 * len(LABELERS)), 0.05), 0.95) for k, v, _ in counts}
    for _ in range(steps):
        prior: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        says = [[[1.0] * 3 for _ in range(2)] for _ in LABELERS]
        for j in range(len(LABELERS)):  # a labeler is right more often than not, until votes say otherwise
            says[j][1][2] += 3.0
            says[j][0][0] += 3.0
        for k, v, n in counts:
            p = post[k, v]
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                prior[k][c] += w
                for j, x in enumerate(votes[v]):
                    says[j][c][x + 1] += w
        new = {}
        for k, v, _ in counts:
            logs = [math.log(prior[k][c] / sum(prior[k])) + sum(math.log(says[j][c][x + 1] / sum(says[j][c])) for j, x in enumerate(votes[v])) for c in (0, 1)]
            new[k, v] = 1 / (1 + math.exp(min(max(logs[0] - logs[1], -700), 700)))
        moved = max((abs(new[x] - post[x]) for x in new), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return post


def classifier(found: DataFrame) -> dict[str, float]:
    """Log odds of each feature value (and of '' alone) from all candidates. What
    comes to the driver are counts by kind and votes, and by feature value and
    these: all are fixed sets."""
    each = found.select(F.explode("__cands").alias("c")).select("c.kind", "c.votes", "c.features")
    rows = each.select("kind", "votes", F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("value")).groupBy("kind", "votes", "value").agg(F.count("*").alias("n")).collect()
    counts = [(r["kind"], r["votes"], r["n"]) for r in rows if r["value"] == ""]
    post = reliabilities(sorted(counts))
    good: dict[str, float] = defaultdict(float)
    bad: dict[str, float] = defaultdict(float)
    for r in sorted(rows, key=str):
        p = post[r["kind"], r["votes"]]
        good[r["value"]] += r["n"] * p
        bad[r["value"]] += r["n"] * (1 - p)
    width: dict[str, int] = defaultdict(int)
    for v in good:
        width[v.partition("=")[0]] += 1
    out = {}
    for v in good:
        if v == "":
            out[v] = math.log((good[v] + 1) / (bad[v] + 1))
        else:
            w = width[v.partition("=")[0]]
            out[v] = math.log((good[v] + 1) / (good[""] + w)) - math.log((bad[v] + 1) / (bad[""] + w))
    return out


def detect(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """All columns of *docs* (without the text if not *keep_text*) and ``spans``:
    (kind, start, end, base) by kind, then start.

    Null and empty texts have none. Rows that repeat are judged each; a column
    named spans is replaced; an empty table gives an empty one. Base spans are
    all in it; of the others those whose classifier score is beyond *threshold*."""
    docs, back = aside(docs.drop("spans"))
    found = candidates(docs, text_col)
    found = cut(found if keep_text else found.drop(text_col), "candidates")
    weights = classifier(found)
    limit = math.log(threshold / (1 - threshold))
    if weights:
        table = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))])
        score = lambda c: F.aggregate(c["features"], F.lit(weights[""]), lambda acc, f: acc + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        kept = F.filter("__cands", lambda c: c["strict"] | (score(c) > limit))
    else:
        kept = F.col("__cands")
    ordered = [F.array_sort(F.transform(F.filter(F.col("__kept"), _of(k)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["strict"].alias("base")))) for k in KINDS]
    return back(found.withColumn("__kept", kept).withColumn("spans", F.concat(*ordered)).drop("__cands", "__kept"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    found = detect(docs.select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of(k, True))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def mask(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span of ``spans`` in the text by its kind in brackets; spans
    that overlap are replaced as a whole, by the kind of the first that starts.
    Drops ``spans``."""
    found, back = aside(found)
    merged = F.array_sort(F.col("spans"))
    span = lambda s, end: F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))
    grown = lambda kept, s: F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(span(F.element_at(kept, -1), F.greatest(F.element_at(kept, -1)["end"], s["end"]))))
    apart = F.aggregate(
        merged,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("kept")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(s["start"] < acc["end"], grown(acc["kept"], s)).otherwise(F.array_append(acc["kept"], span(s, s["end"]))).alias("kept"),
        ),
    )["kept"]
    df = found.withColumn("__apart", apart)
    t, n = F.col(f"`{text_col}`"), F.size("__apart")
    piece = lambda s, i: F.concat(F.substring(t, F.when(i > 0, F.get(F.col("__apart"), i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(F.col("__apart"), i - 1)["end"]).otherwise(0)), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    last = F.get(F.col("__apart"), n - 1)["end"]
    masked = F.concat(F.array_join(F.transform(F.col("__apart"), piece), ""), F.substring(t, last + 1, F.length(t)))
    return back(df.withColumn(text_col, F.when(n > 0, masked).otherwise(t)).drop("spans", "__apart"))
