"""Near-duplicate classes against brute force over the full shingle sets."""

import random
import re

import pytest

from terrascore.llm import neardup
from terrascore.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, at = [shingles(t) for _, t in rows], {}
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= 75 * either:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {(i, len(s)): find(i) for (i, _), s in zip(rows, sets)}


def _check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.near_duplicates(df).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == want[(r["doc_id"], r["n_shingles"])], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_against_brute_force(spark):
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 5000)}é" for _ in range(rnd.randint(30, 400))] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10 ** 6)}"
        rows.append((1000 - i, rnd.choice([" ", "\n", " \t "]).join(words).replace("w1", rnd.choice(["w1", "W1"]))))
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "a b"), (2004, "A  B"), (2005, "a b c"), (2006, "a b c d e"),
             (2007, "x y a b c d e"), (2008, " ".join("abcdefgh")), (2009, " ".join("abcdefg")), (2010, "a\x85b"), (2011, "\xa0a b")]
    chain = [f"c{i}" for i in range(60)]
    rows += [(3000 + k, " ".join(chain[:40 + k])) for k in range(0, 20)]
    _check(spark, rows)


def test_table_of_the_sample(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    _check(spark, rows)


def test_repeated_ids_nulls_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(50))
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(3, text), (5, text), (5, other), (9, other), (None, text), (7, None), (7, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == \
        [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (9, 3, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_near_the_similarity():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, shared in ((200, 150), (2000, 1800), (20, 18)):
        a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:shared], rnd.integers(0, 1 << 63, n - shared, dtype=np.uint64)])
        est = neardup.estimates(*[neardup.registers(np.unique(x)).view("<i8")[None, :] for x in (a, b)], *[np.array([n])] * 2)[0]
        assert est == pytest.approx(shared / (2 * n - shared), abs=0.16)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(200, 201), (203, 203)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(91)}, 200: 200, 201: 200}


def test_one_table_of_powers_is_kept(monkeypatch):
    import sys

    import numpy as np

    monkeypatch.delitem(sys.modules, "_terrascore_worker", raising=False)
    for n in (1, 9, 1 << 16, 1 << 18, 1 << 20, (1 << 20) + 1):
        data = np.frombuffer(b"ab " * (n // 3 + 1), np.uint8)[:n]
        hashes, _ = neardup.word_hashes(data, np.array([0, n]))
        assert len(np.unique(hashes[:n // 3])) <= 1 and len(hashes) == -(-n // 3)
    kept = vars(sys.modules["_terrascore_worker"])["memo"]
    assert [k for k in kept if k[0] == "dup-powers"] == [("dup-powers", neardup.CHUNK)]
    monkeypatch.delitem(sys.modules, "_terrascore_worker")
