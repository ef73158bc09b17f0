"""Mixing and packing on small fixtures, against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_pieces_equal_whole_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", None, "Don't STOP, it's 2024!", "café Ünïted ÉTÉ straße", "<|endoftext|> in text", "a\x1cb\x85c\xa0d",
           "漢字 and Σίσυφος", "x" * 5000, "w " * 9000, "İstanbul ıs ﬁne", "tab\tnew\nline\r\n end", "'S 't '"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd)]
    got = {}
    for r in packing.pieces(_docs(spark, rows), with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])))
    for i, t in enumerate(odd):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(k, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()), ids[at:at + 4096])
                for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[i]) == want


def test_worker_gives_up_what_earlier_stages_kept(monkeypatch):
    import sys

    from terrascore.llm import shared

    monkeypatch.delitem(sys.modules, "_terrascore_worker", raising=False)
    shared.worker_memo("table", lambda: np.zeros(9))
    assert shared.worker_state("coder", lambda: 1) == 1
    assert "memo" not in vars(sys.modules["_terrascore_worker"])
    shared.worker_memo("table", lambda: 2)  # kept while the state is
    assert shared.worker_state("coder", lambda: 3) == 1 and shared.worker_memo("table", lambda: 4) == 2
    monkeypatch.delitem(sys.modules, "_terrascore_worker")


def test_encoder_reads_a_chunk_at_a_time(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = packing._Encoder(f.read())
    texts, read = [f"word{i % 7} and " * 200 for i in range(2000)], []
    ids = coder.encode_all(read.append(i) or t for i, t in enumerate(texts))
    next(ids)
    assert len(read) * len(texts[0]) <= 1.1 * (1 << 20)
    monkeypatch.setattr(packing, "MEMO_BYTES", 1000)  # a memo that is emptied all the time
    again = packing._Encoder(coder.whole.to_str())
    assert [next(ids) for _ in range(6)] == list(again.encode_all(texts[1:7]))


def test_a_word_with_and_without_punctuation_is_encoded_once():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = packing._Encoder(f.read())
    asked = []

    class Asked:
        def tokenize(self, piece, model=coder.model):
            asked.append(piece)
            return model.tokenize(piece)

    coder.model = Asked()
    texts = ["Mountain, mountain. mountain! mountain%%% mountain", "élan, élan. Élan;", "mountain's it's", "\x01 mountain", ""]
    got = [list(memoryview(ids).cast("I")) for ids in coder.encode_all(texts)]
    assert got == [coder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("mountain") == 1 and len(asked) == len(set(asked))


def test_plan_fills_without_overlap():
    rnd = random.Random(5)
    for _ in range(30):
        cap = rnd.choice([7, 64, 100])
        counts = {n: rnd.randint(1, 200) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, 7))}
        rows = sorted(packing.plan_slots(counts, cap))
        used = {}
        for k, (length, rank, first, each, offset) in enumerate(rows):
            stop = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
            for j in range(stop - rank):
                used.setdefault(first + j // each, []).append((offset + j % each * length, length))
        total = sum(n * c for n, c in counts.items())
        for spans in used.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= cap
        assert len(used) <= 2 * -(-total // cap)


def test_pack_gapless_and_repeated_rows(spark):
    rnd = random.Random(1)
    rows = [(i // 2, " ".join(["word"] * rnd.choice([1, 5, 900, 3000, 5000])), "en", "s", 0) for i in range(60)]
    out = packing.pack(packing.pieces(_docs(spark, rows), with_ids=True))
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    sizes = {r["sequence_id"]: r["n"] for r in packing.sequences(out).select("sequence_id", F.size("ids").alias("n")).collect()}
    assert sizes == {k: sum(n for _, n in v) for k, v in by.items()}
    assert packing.pack(packing.pieces(_docs(spark, []))).count() == 0


def test_targets_level(spark):
    s = spark.createDataFrame([("a", 100, 3), ("b", 1000, 1), ("c", 10, 2), (None, 0, 3)], "source string, source_size long, weight int")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    # 1665 words; a and c stop at twice their size, b takes the rest
    assert got == {"a": 200.0, "b": pytest.approx(1445.0), "c": 20.0, None: 0.0}


def test_mix_near_target_with_nulls_ties_and_extra_columns(spark):
    rnd = random.Random(2)
    rows = [(None if i == 7 else i // 2 if i < 10 else i, None if i % 31 == 0 else " ".join(["w"] * rnd.randint(0, 40)),
             "en", rnd.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(400)]
    docs = _docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("_x", F.lit(1))
    out = mixing.mix(docs).collect()
    assert len(out) == 400
    per = {}
    for r in out:
        per.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(x[1] for x in per.values()) == pytest.approx(1.5 * sum(x[2] for x in per.values()))
    for taken, target, _ in per.values():
        assert abs(taken - target) <= 20
    assert mixing.mix(_docs(spark, [])).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns
