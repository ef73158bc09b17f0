"""The pipeline stage by stage against plain Python on a small table."""

import os
import re
import subprocess
import sys

import corpus_pipeline as P
from terrascore.llm import langid, toxicity
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}

    one = P.language(spark, docs, SF)
    names = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))).collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, (n, s) in names.items() if n != "und" and s >= P.LEAST_LANGUAGE}
    assert one.columns == columns

    two = P.clean(spark, one, SF)
    kept = {r["doc_id"] for r in two.collect()}
    marked = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert two.columns == columns
    assert len((set(rows) - kept) - marked) <= 0.02 * len(rows)

    three = P.distinct(spark, two, SF)
    top = brute([(i, rows[i]["text"]) for i in sorted(kept)])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(top.values()))
    assert three.columns == columns

    four = P.mixed(spark, three, SF)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    have, mix = sum(map(size, three.collect())), sum(map(size, four.collect()))
    assert four.columns == columns and abs(mix - 1.5 * have) < 0.1 * have

    five = P.packed(spark, four, SF).collect()
    assert sorted(r["doc_id"] for r in five if r["piece"] == 0) == sorted(r["doc_id"] for r in four.collect())
    by = {}
    for r in five:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096


def test_odd_rows(spark):
    text = " ".join(f"the word{i} of a house" for i in range(30))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", None, 1), (None, text, None, "b", None), (3, None, "en", "a", 0),
            (4, "", None, "b", 0), (5, "1234 !!!", "en", "c", 8), (6, "other words of the house and a garden", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = P.language(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 1, 2, 6]
    two = P.distinct(spark, one, SF)
    assert sorted(r["doc_id"] or 0 for r in two.collect()) == [0, 1, 6]
    assert P.packed(spark, P.mixed(spark, two, SF), SF).count() > 0
    empty = docs.where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
    assert toxicity.fit(docs.where("false"), docs.selectExpr("doc_id", "1 as toxic")) is None


def test_rows_without_id_are_judged_one_by_one(spark, monkeypatch):
    text = " ".join(f"the word{i} of a house" for i in range(30))
    rows = [(None, text, "en", "a", 1), (None, "1234 !!!", "en", "a", 1), (7, text + " bad", "en", "a", 1), (7, text, "en", "a", 1),
            (None, text + " bad", "en", "a", 1), (7, "5678 ???", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = P.language(spark, docs, SF)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in one.collect()) == sorted((r[0] or 0, r[1]) for r in rows if "word" in r[1])
    # a model by which a text with "bad" is toxic
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: ((b"", b""), None, [1.0], -0.5))
    monkeypatch.setattr(toxicity, "_compressors", lambda *a: (None, None))
    monkeypatch.setattr(toxicity, "savings", lambda t, *a: t)
    monkeypatch.setattr(toxicity, "features", lambda t, *a: [10.0 * t.endswith("bad")])
    two = P.clean(spark, one, SF)
    assert two.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in two.collect()) == [(0, text), (7, text)]


def test_mix_draws_rows_without_id_one_by_one(spark):
    rows = [(None, f"text {i} of six words here", "en", s, 1) for s in "abc" for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by = {r["source"]: r["count"] for r in P.mixed(spark, docs, SF).groupBy("source").count().collect()}
    # 1.5 x 180 documents by weights 3, 1, 2, at most 120 of a source
    assert by == {"a": 120, "b": 50, "c": 100}


def test_columns_with_clashing_names(spark):
    text = " ".join(f"the word{i} of a house" for i in range(30))
    rows = [(1, text, "en", "a", 1, 0.5, 7, "x", 3, 9, 1), (1, text, "en", "a", 1, 0.5, 7, "x", 3, 9, 1), (2, text + " b", "en", "a", 1, 0.5, 8, "y", 4, 9, 2),
            (5, "other words of the house and a garden", "en", "b", 1, 0.1, 9, "z", 5, 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted long, "
                                       "lang_pred string, _id long, r long, size long")
    before = {r["doc_id"]: (r["score"], r["predicted"], r["lang_pred"], r["_id"], r["r"], r["size"]) for r in docs.collect()}
    one = docs
    for _, stage in P.STAGES[:-1]:
        one = stage(spark, one, SF)
        assert one.columns == docs.columns
        found = one.collect()
        assert found and all((r["score"], r["predicted"], r["lang_pred"], r["_id"], r["r"], r["size"]) == before[r["doc_id"]] for r in found)
    assert {r["doc_id"] for r in found} == {1, 5}
    assert P.packed(spark, one, SF).count() == len(found)


def test_workers_need_no_installed_package(tmp_path):
    """Run where only the driver's path has the package."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as E
from terrascore.session import get_session
spark = get_session("local[2]", shuffle_partitions=4, extra={{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.driver.memory": "2g"}})
for name in ("op2_neardup", "op3_topk", "op4_langid", "op5_html", "op8_packing", "op10_toxicity", "op11_chat", "op12_trie", "op13_resample"):
    print(name, E.queries()[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and len(done.stdout.split()) == 18, done.stderr[-2000:]
