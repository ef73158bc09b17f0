"""Held-out quality and edge cases of the two text filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = langid.op4_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id")
    assert held.where(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * held.count()
    assert out.count() == docs.count()


def test_language_edge_cases(spark):
    rows = [(1, "el perro come la comida del gato", "es"), (2, "the dog eats the food of the cat", "en"), (3, None, "en"),
            (4, "1234 !!", "en"), (5, "", "es"), (5, "the the", None), (None, "the cat", None), (6, "the cat " * 40000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    filters = langid.fit(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, filters).collect()]
    assert len(got) == len(rows)
    assert {(d, x) for d, x, _ in got} == {(1, "es"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (5, "en"), (None, "en"), (6, "en")}
    assert all(0 <= s <= 1 for *_, s in got)
    empty = docs.where("false")
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_grams_against_plain_python():
    texts = ["Ab, c!", "", None, "é", "a", "x y", "  lead"]
    codes, sizes = langid.grams(texts)

    def plain(t):
        t = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        s = " " + " ".join(t.split()) + " " if t.split() else ""
        return [s[i:i + 3] for i in range(len(s) - 2)]
    want = [plain(t) for t in texts]
    assert list(sizes) == [len(w) for w in want]
    got = ["".join(chr(int(c) >> k & 0x1FFFFF) if int(c) >> k & 0x1FFFFF else " " for k in (42, 21, 0)) for c in codes]
    assert got == [g for w in want for g in w]


def test_false_positives_are_corrected():
    rnd = np.random.default_rng(0)
    codes = np.unique(rnd.integers(1, 1 << 60, 2000, dtype=np.uint64))
    members = np.zeros((len(codes), 70), bool)
    members[np.arange(len(codes)), np.arange(len(codes)) % 70] = True
    f = langid.Filters([f"l{i:02}" for i in range(70)], codes, members)
    hits = f.hits(codes, np.array([len(codes)]))[0]
    assert np.allclose(hits, members.sum(axis=0), atol=6)


def test_toxicity_finds_planted_words(spark):
    rnd = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rnd.integers(0, 300)}x" .translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rnd.integers(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words[rnd.integers(0, len(words))] = str(rnd.choice(["zounderkite", "fopdoodle", "mumblecrust"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id < 300"))
    got = toxicity.score(docs, model).join(known, "doc_id").where("doc_id >= 300")
    assert got.where("predicted = 1 AND toxic = 1").count() >= 20
    assert got.where("predicted = 1 AND toxic = 0").count() <= 2


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (3, "!!"), (None, "word"), (4, "long " * 30000)], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert toxicity.score(docs, None).where("score = 0").count() == 6
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (9, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_logistic_recovers_weights():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(4000, 2))
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(int)
    w, b = toxicity.logistic(x, y, 1e-6)
    assert w == pytest.approx([2, -1], abs=0.2) and b == pytest.approx(0.5, abs=0.15)


def test_copies_are_of_one_label_and_most_hashes():
    a = [f"w{i}" for i in range(60)]
    shared = [f"p{i}" for i in range(30)]
    rows = [(a, 0), (a, 0), (a[:58] + ["x", "y"], 0), (a, 1), (shared + [f"q{i}" for i in range(90)], 0), ([f"r{i}" for i in range(90)] + shared, 0)]
    left = toxicity.without_copies(rows)
    assert len(left) == 4 and [y for _, y in left] == [0, 1, 0, 0]


def test_scores_against_a_plain_loop(spark):
    """The query's scores are those of each text's windows, one after the other."""
    import numpy as np
    from pyspark.sql import functions as F
    from terrascore.llm.shared import fold

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where(fold(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs, labels)
    assert model is not None
    dictionaries, ratios, weights, intercept = model
    plain, both = toxicity._compressors(*dictionaries)
    for r in toxicity.op10_toxicity(spark, sf).join(docs, "doc_id").collect():
        words = toxicity.WORD.findall((r["text"] or "").lower())
        saved = []
        for i in range(0, len(words), toxicity.WINDOW):
            window = f" {' '.join(words[i:i + toxicity.WINDOW])} ".encode()
            saved.append(len(plain.compress(window)) - len(both.compress(window)))
        x = toxicity.features(np.array(saved, dtype=np.int64), ratios)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(x @ weights + intercept, -500, 500)))) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_languages_against_exact_sets(spark):
    """The filters' corrected counts name the language that exact sets of
    typical trigrams name."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    found = langid.identify(docs, langid.fit(docs)).collect()  # fewer texts a language than the sample takes: all are learned from

    def grams(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = " " + " ".join(low) + " " if low else ""
        return [padded[i:i + 3] for i in range(len(padded) - 2) if padded[i:i + 2].strip() or padded[i + 1:i + 3].strip()]

    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(grams(r["text"]))
    rate = {lang: {g: n / sum(x for x in c.values() if x > 1) for g, n in c.items() if n > 1} for lang, c in counts.items()}
    most = Counter()
    for known in rate.values():
        for g, v in known.items():
            most[g] = max(most[g], v)
    typical = {lang: {g for g, v in known.items() if v >= langid.TYPICAL * most[g]} for lang, known in rate.items()}
    agree = close = 0
    for r in found:
        own = grams(next(x["text"] for x in rows if x["doc_id"] == r["doc_id"]))
        hits = {lang: sum(g in s for g in own) for lang, s in typical.items()}
        best = max(sorted(hits), key=hits.get)
        agree += r["lang_pred"] == (best if own else langid.UNKNOWN)
        close += abs(r["score"] - (hits[best] / len(own) if own else 0.0)) < 0.03
    assert agree >= 0.99 * len(found) and close >= 0.98 * len(found), (agree, close, len(found))
