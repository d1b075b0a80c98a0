"""Quality, personal data, languages, shards and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, minhash, pii, quality, segments, sharding
from tests.llm import cases


def test_measures_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in quality.judge(cases.odd_docs(spark)).collect()}
    for doc, text, *_ in cases.odd_rows():
        want = cases.measures(text)
        assert tuple(got[doc][m] for m in quality.MEASURES) == want
        assert got[doc]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.judge(cases.empty_docs(spark)).count() == 0


def test_hosts_with_many_failures_are_distrusted(spark):
    good = " ".join(f"word{i}" for i in range(30))
    odd = " ".join(f"w{i}###" for i in range(30))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, odd if i < 30 else good, "bad") for i in range(40)] + [(200, odd, "fine"), (201, odd, None), (202, good, "bad")]
    r = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert r[100]["host_rate"] > 0.5 > r[0]["host_rate"] and r[201]["host_rate"] is None
    assert not r[100]["kept"] and r[202]["kept"] and r[200]["kept"] and r[201]["kept"]
    raw = 30 / 41
    assert r[100]["host_rate"] < raw  # shrunk towards the common rate


def test_base_spans_equal_brute_force(spark):
    extra = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1", "4111-1111 1111  1111 4111 1111 1111 1111", "+1+12345678901 ", "1 " * 3000, "a@" + "b." * 5000 + "c", "1.1." * 500, "x  41111111 1111 1111 1"]
    rows = cases.odd_rows() + [(50 + i, t, "en", "a", 0) for i, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in pii.summary(cases.odd_docs(spark, rows)).collect()}
    for doc, text, *_ in rows:
        want = cases.base_spans(text)
        assert [got[doc][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert got[doc]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert {"%s:%d:%d" % s for s in want} <= set(got[doc]["spans"].split(",")) | {""}
    assert pii.summary(cases.empty_docs(spark)).count() == 0


def test_more_spans_and_masks(spark):
    docs = spark.createDataFrame([(1, "call (555) 123-4567 or mail joe at home dot org, Mr. John Smith"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    found = pii.detect(docs)
    kinds = {s["kind"] for s in found.where("doc_id = 1").first()["spans"]}
    assert {"phone", "email"} <= kinds and not any(s["base"] for s in found.where("doc_id = 1").first()["spans"])
    text = {r["doc_id"]: r["text"] for r in pii.mask(found).collect()}
    assert "[PHONE]" in text[1] and "4567" not in text[1] and text[2] == "nothing here" and text[3] is None


def test_masks_cover_overlapping_spans(spark):
    kinds = "doc_id long, text string, spans array<struct<start:int,end:int,kind:string,base:boolean>>"
    rows = [
        (1, "+12345678901@x.com is it", [(0, 18, "email", True), (0, 12, "phone", True)]),
        (2, "a 4111 1111 1111 1111.0.0.1 b", [(2, 21, "card", True), (17, 27, "ip", True)]),
        (3, "abcdefghij", [(1, 8, "email", True), (2, 4, "ip", True), (7, 9, "phone", True), (9, 10, "card", True)]),
        (4, "none", []),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: "[PHONE] is it", 2: "a [CARD] b", 3: "a[EMAIL][CARD]", 4: "none"}


def test_reliabilities_trust_the_agreeing_labelers():
    counts = [("a", "1,1,1,1,1", 80), ("a", "-1,-1,-1,1,-1", 100), ("a", "1,1,1,-1,1", 60)]
    post = pii.reliabilities(counts)
    assert post["a", "1,1,1,-1,1"] > 0.9 > 0.1 > post["a", "-1,-1,-1,1,-1"]
    assert pii.reliabilities([]) == {}


def test_no_python_in_the_plan_of_personal_data(spark):
    plan = pii.summary(cases.odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_languages(spark):
    words = {"en": "the and thing with shore that", "de": "der schein und über groß nicht", "fr": "le quelque chose où même avec"}
    rows = [(i, " ".join((w.split() * 6)[i % 6 : i % 6 + 20]), lang) for i in range(60) for lang, w in [list(words.items())[i % 3]]]
    got = langid.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["lang_pred"] == lang[r["doc_id"]] and 0 <= r["score"] <= 1 for r in held)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(cases.odd_docs(spark)).collect()}
    assert all(odd[i] == "und" for i in (1, 2, 3, 17)) and odd[6] != "und"
    assert langid.predicted(cases.empty_docs(spark)).count() == 0


def test_held_out_accuracy_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r["a"] > 0.97


def test_predictions_do_not_depend_on_neighbours():
    code = langid.codewords(2)
    model = langid.Model(["a", "b"], code, np.random.default_rng(0).normal(size=(langid.BUCKETS * 3, code.shape[1])).astype(np.float32), np.ones(code.shape[1]))
    texts = ["some words", "", "más", "x"]
    together = model.predict(pa.array(texts))
    for i, t in enumerate(texts):
        alone = model.predict(pa.array([t]))
        assert alone[0][0] == together[0][i] and alone[1][0] == pytest.approx(together[1][i])


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    assert all(-1 in c and 1 in c for c in code.T.tolist())


def test_shards(spark, tmp_path):
    docs = cases.odd_docs(spark).repartition(6)
    table = sharding.Shards(spark, str(tmp_path / "t"), target=60_000)
    assert table.version() == 0
    table.append(docs, 2)
    table.append(docs, 2)
    first = table.manifest().count()
    version = table.compact()
    assert version > 2 and table.manifest().count() < first
    for v, n in ((1, 1), (version, 2)):
        want = docs if n == 1 else docs.unionByName(docs)
        assert table.read(v).exceptAll(want).count() == 0 and want.exceptAll(table.read(v)).count() == 0
    assert table.plan().count() == 0
    table.vacuum()
    assert table.read().count() == 2 * docs.count() and table.version() == version
    with pytest.raises(RuntimeError):
        table._commit(table.manifest(), [], version)


def test_shards_of_nothing(spark, tmp_path):
    table = sharding.compacted(cases.empty_docs(spark), str(tmp_path / "t"))
    assert table.read().count() == 0 and table.version() == 1


def test_pipeline_by_brute_force(spark):
    """With columns that have the names that operators use themselves."""
    docs = cases.odd_docs(spark).withColumns({c: F.lit(f"own {c}") for c in ("__t", "kept_text", "tkey", "__key", "row", "a", "cid", "sequence_id")}).withColumn("key", F.col("doc_id"))
    columns, kept = docs.columns, {}
    own = [c for c in columns if c not in ("text", "n_chars")]
    before = {r["doc_id"]: tuple(r[c] for c in own) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        kept[name] = docs.collect()
        if name != "packed_sequences":
            assert docs.columns == columns
            assert all(tuple(r[c] for c in own) == before[r["doc_id"]] for r in kept[name])
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    fails = {r[0] for r in cases.odd_rows() for m in [cases.measures(r[1])] if m[0] < 10 or 100 * m[4] > 20 * m[0]}
    assert ids("quality_rules") == {r[0] for r in cases.odd_rows()} - fails
    want = cases.components([(r["doc_id"], r["text"]) for r in kept["quality_rules"]])
    assert ids("near_duplicates") == {d for d, (_, c) in want.items() if c == d}
    texts = [(r["doc_id"], r["text"]) for r in kept["near_duplicates"]]
    sizes = {d: x[0] - x[1] for d, x in cases.without_repeats(texts, 100).items()}
    assert {r["doc_id"]: len(r["text"].encode()) for r in kept["repeated_passages"]} == sizes
    masked = {r["doc_id"]: r["text"] for r in kept["personal_data"]}
    assert "me@home.org" not in masked.get(15, "") and all(r["n_chars"] == len(r["text"]) for r in kept["personal_data"])
    lib = segments.BytePairs().library
    ids_of = {d: lib.encode(t, add_special_tokens=False).ids + [0] for d, t in masked.items()}
    packed = sorted(kept["packed_sequences"], key=lambda r: (r["doc_id"], r["piece"]))
    assert ids("packed_sequences") == ids("personal_data") and all(r["length"] <= 2048 for r in packed)
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4"))
    assert sum(r["length"] for r in packed) == sum(map(len, ids_of.values()))


def test_pipeline_of_nothing(spark):
    docs = cases.empty_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_near_duplicates_read_whole_texts(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(2000)) + " " + " ".join(f"v{i}" for i in range(2000))
    rows = [(1, a), (2, b), (3, a + " x")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [32, 1024, 2048, 4096])
def test_words_of_two_letters_that_collide_modulo_a_power_of_two(spark, n):
    """A word over a and b and its complement: equal by a polynomial hash modulo 2**64."""
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    assert quality.measure(pa.array([f"{x}\n{y}"]))["n_dup_lines"][0] == 0
    got = minhash.near_duplicates(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1, 2}


def test_rows_of_one_document_with_other_texts_are_one(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " x"), (8, "alone"), (None, a), (5, "")]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (None, None), (5, 5)], key=str)


def test_languages_by_loss_to_every_codeword():
    """The choice, ties by order, against a plain loop over languages and bits."""
    rng = np.random.default_rng(3)
    code = langid.codewords(9)
    model = langid.Model(list("abcdefghi"), code, rng.normal(size=(langid.BUCKETS * 3, code.shape[1])).astype(np.float32), rng.random(code.shape[1]))
    texts = ["some words here", "más über", "x", "ein zwei drei vier " * 20]
    names, score, _ = model.predict(pa.array(texts))
    for t, got, s in zip(texts, names, score):
        g, ends = langid.grams(pa.array([t]))
        margin = model.weights[g[: ends[-1]]].sum(0) * 4 / np.sqrt(max(int(ends[-1]), 1) / len(langid.ORDERS)) / len(langid.ORDERS)
        loss = [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(model.loss_weight, margin, row)) for row in model.code]
        assert got == model.languages[int(np.argmin(loss))]
        assert s == pytest.approx(1 / np.exp(-(np.array(loss) - min(loss))).sum())


def test_learned_weights_equal_brute_force(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("the end", "en"), (None, "en"), ("nobody", None), ("", "de"), ("x", "lone")])]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr", "lone"]
    width = langid.BUCKETS * 3
    counts = np.zeros((4, width))
    for _, t, k in rows:
        if t is not None and k:
            g, ends = langid.grams(pa.array([t]))
            np.add.at(counts[model.languages.index(k)], g[: ends[-1]], 1)
    share = counts + 0.5
    for k in range(3):
        own = slice(k * langid.BUCKETS, (k + 1) * langid.BUCKETS)
        share[:, own] /= share[:, own].sum(1, keepdims=True)
    for b in range(model.code.shape[1]):
        w = np.log(share[model.code[:, b] > 0].mean(0)) - np.log(share[model.code[:, b] < 0].mean(0))
        assert np.allclose(model.weights[:, b], w, atol=1e-5)
        assert np.isclose(model.loss_weight[b] / model.loss_weight[0], max((share @ w / 3 * model.code[:, b]).min(), 1e-3) / max((share @ model.weights[:, 0] / 3 * model.code[:, 0]).min(), 1e-3), rtol=1e-3)


def test_three_hundred_labels_are_learned(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèñçåø"))
    rows = []
    for k in range(300):
        own = ["".join(rng.choice(letters, rng.integers(3, 7))) for _ in range(25)]
        rows += [(1000 * k + j, " ".join(rng.choice(own, 40)), f"l{k:03d}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where("doc_id % 1000 < 3"))
    assert len(model.languages) == 300 and len({x.tobytes() for x in model.code}) == 300 and model.distance > 0
    got = langid.identify(docs.where("doc_id % 1000 = 3"), model).collect()
    assert len(got) == 300 and sum(r["lang"] == r["lang_pred"] for r in got) > 285


def test_clashing_names_of_columns(spark):
    docs = spark.createDataFrame([(1, "me@home.org said hi", "a", 5, 6)], "doc_id long, text string, source string, __t int, __kept int")
    assert pii.mask(pii.detect(docs)).first().asDict() == {"doc_id": 1, "text": "[EMAIL] said hi", "source": "a", "__t": 5, "__kept": 6}
    told = quality.judge(docs.withColumnRenamed("__t", "__text")).first()
    assert told["__text"] == 5 and told["n_words"] == 3
    assert langid.identify(docs.withColumnRenamed("__t", "__text"), langid.learn(docs.withColumn("lang", F.lit("en")))).first()["__text"] == 5


def test_tiers_are_planned_in_parts_and_waves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 3)
    docs = cases.odd_docs(spark).repartition(9)
    table = sharding.Shards(spark, str(tmp_path / "t"), target=60_000, fanout=2, wave=1)
    table.append(docs, 1)
    n = table.manifest().count()
    table.compact()
    assert table.manifest().count() < n and table.plan().count() == 0
    table.vacuum()
    assert table.read().exceptAll(docs).count() == 0 and table.read().count() == docs.count()


def test_manifests_are_changes_and_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FOLD", 3)
    table = sharding.Shards(spark, str(tmp_path / "t"), target=60_000, fanout=2, wave=1)
    seen = []
    for i in range(5):
        table.append(spark.range(10 * i, 10 * i + 10).coalesce(1), 5)
        seen.append(sorted(r["path"] for r in table.manifest().collect()))
    assert [len(x) for x in seen] == [2, 4, 6, 8, 10] and (tmp_path / "t/manifest/s00000003").exists()
    assert [sorted(r["path"] for r in table.manifest(v).collect()) for v in range(1, 6)] == seen
    table.compact()
    assert table.manifest().count() < 10 and sorted(r["id"] for r in table.read().collect()) == list(range(50))
    assert sorted(r["id"] for r in table.read(5).collect()) == list(range(50)) and table.read(2).count() == 20
    table.vacuum()
    assert sorted(r["id"] for r in table.read().collect()) == list(range(50))
    assert len(list((tmp_path / "t/manifest").iterdir())) == 2
